"""Where rows come from and go to: requests, providers, and the snapshot store."""
