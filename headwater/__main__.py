import sys

from headwater.cli import main

sys.exit(main())
