"""Where rows come from: files, document parts, stored tables."""
