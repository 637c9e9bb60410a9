import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # small matrices only: threads would wait for each other
