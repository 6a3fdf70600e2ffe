import os
import sys

# Test modules here share helpers by name.
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
