"""A jq front end: expressions become Columns and DataFrame plans where they can, and run row by row where not."""
