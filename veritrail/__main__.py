from veritrail.cli import main

raise SystemExit(main())
