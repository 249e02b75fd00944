import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from engramlake.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = byte_bpe.Codec(RANKS, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])) | st.text(alphabet=" \n\t \x85\x1cab'sé1.日", max_size=30))
def test_ids_are_those_of_the_rank_encoder(text):
    ids = OWN.encode([text])[0]
    assert ids.tolist() == TIK.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


def test_every_piece_and_forgetting(monkeypatch):
    texts = [b.decode() for b in list(RANKS)[::7] if b.isascii() or not b.decode("utf-8", "replace").count("�")]
    monkeypatch.setattr(byte_bpe, "CACHE_CHUNKS", 50)
    for i in range(0, len(texts), 40):
        joined = " ".join(texts[i : i + 40])
        assert OWN.encode([joined])[0].tolist() == TIK.encode_ordinary(joined)


def test_frame_edges(spark):
    rows = [(1, None, 5), (2, "", None), (3, "a  b\n\n c \n", 7), (3, "a  b\n\n c \n", 7), (None, "x" * 300_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 int")
    coded = byte_bpe.encode(df, PATH, P.PATTERN, decode=True)
    assert coded.columns == ["doc_id", "c0", "ids", "decoded"]
    for r in byte_bpe.digests(coded).collect():
        text = next((t or "") for d, t, _ in rows if d == r.doc_id)
        ids = TIK.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
    assert byte_bpe.decode(coded.drop("decoded"), PATH, P.PATTERN).where("doc_id = 3").first().decoded == b"a  b\n\n c \n"


def test_whole_table_against_the_rank_encoder(spark):
    got = {r.doc_id: r.ids_sha256 for r in byte_bpe.query(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = TIK.encode_ordinary(r.text or "")
        assert got[r.doc_id] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
