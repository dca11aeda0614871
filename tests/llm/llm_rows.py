"""Rows that every operator has to bear."""

ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "a"), (5, "a"), (5, "a"), (None, "b c"), (6, "É ß 漢字 🙂  x"), (7, "word " * 3000)]
DOCS = "doc_id long, text string"
