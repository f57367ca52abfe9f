"""Operations of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with a general interface; :mod:`.queries`
registers one query per operator over the given tables.
"""
