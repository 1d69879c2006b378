"""Training-data operators. Each module holds one operator; ``registry``
lists their queries. Nothing outside this package imports it except the guard
in ``__spark_entry__.py``."""
