import sys

from logshape.cli import main

sys.exit(main())
