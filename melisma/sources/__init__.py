"""Where rows come from and go to: files, REST pages, snapshots."""
