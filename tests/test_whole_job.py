"""Operators do the whole job where the given SQL, on its small tables, can't tell."""

from packlens.plans import registry

QUERIES = registry.queries()


def test_squeezed_containment_slides_its_window(spark, tmp_path):
    names = ["xetal bottle cap", "METAL-BOTTLE CAP", "abc", "abcd", "zz abcd", ""]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.a: r.inside for r in QUERIES["m16_squeezed_containment"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: None, 3: True, 4: False}
