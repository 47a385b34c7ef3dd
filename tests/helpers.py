import math


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, norm(v)) for k, v in value.items())
    if isinstance(value, list | tuple):
        return tuple(map(norm, value))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(relation):
    names = sorted(relation.columns)
    at = [relation.columns.index(c) for c in names]
    return names, sorted((tuple(norm(r[i]) for i in at) for r in relation.fetchall()), key=repr)
