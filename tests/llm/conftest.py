import sys
from pathlib import Path

# the pipeline lies at the top of the repository
sys.path.insert(0, str(Path(__file__).parents[2]))
