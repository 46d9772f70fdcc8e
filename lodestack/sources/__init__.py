"""Sources: file listings, image and report files, manifests."""
