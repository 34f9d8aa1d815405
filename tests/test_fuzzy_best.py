"""Names whose words all begin otherwise are found too."""

from presslens.operators.joins import fuzzy_best


def test_changed_initials(spark):
    names = [("kohnson",), ("blan sobertson",), ("robertson alan",), ("x",), ("",)]
    known = [("johnson",), ("alan robertson",), ("y",)]
    got = {r.name: (r.match, r.score) for r in fuzzy_best(spark.createDataFrame(names, "name string"), "name", spark.createDataFrame(known, "known string"), "known").collect()}
    assert got == {"kohnson": ("johnson", 85.714286), "blan sobertson": ("alan robertson", 85.714286), "robertson alan": ("alan robertson", 100.0)}
