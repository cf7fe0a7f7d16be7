"""Query plans over relations of documents."""
