"""vectrail: vector entity resolution and its evaluation, as DataFrame transformations."""
