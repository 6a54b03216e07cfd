import sys

from parity.cli import main

sys.exit(main())
