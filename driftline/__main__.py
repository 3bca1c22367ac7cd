import sys

from driftline.plans.cli import main

sys.exit(main())
