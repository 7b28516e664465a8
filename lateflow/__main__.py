"""``python -m lateflow ...`` is the command line of ``lateflow.cli``."""

import sys

from lateflow.cli import main

sys.exit(main())
