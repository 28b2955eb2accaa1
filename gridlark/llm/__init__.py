"""Training-data operators: text, token, page, vector and media tables at corpus scale."""
