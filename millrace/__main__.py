from millrace.cli import main

raise SystemExit(main())
