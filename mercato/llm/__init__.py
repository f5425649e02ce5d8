"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""


def queries():
    from .op_queries import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from .op_queries import ORACLES

    return dict(ORACLES)
