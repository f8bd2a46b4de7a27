import sys

from unitflow.plans.run import main

sys.exit(main())
