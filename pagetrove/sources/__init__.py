"""Where rows come from and go to: seeds, page snapshots, feeds, the store."""
