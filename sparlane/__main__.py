from .modes import main

raise SystemExit(main())
