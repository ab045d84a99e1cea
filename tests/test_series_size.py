"""Series plans shuffle what can meet a relation, not every listed file."""

from dupelake.operators import folders as FO
from dupelake.plans import skew


def test_only_paths_below_a_destination_are_looked_up(spark):
    listing = spark.createDataFrame([(p,) for p in ("/merged/a/x.mp4", "/merged/a b/x.mp4", "/merged/b/y.mp4", "/vault/a/x.mp4", "/a.mp4", "/merged", "/merged0")], "path string")
    roots = spark.createDataFrame([("s1", "/merged/a"), ("s2", "/merged/a b"), ("s3", "/merged/b/")], "set_id string, destination string")
    taken = {r.target for r in FO._taken(listing, roots, "target", "__t").collect()}
    assert taken == {"/merged/a/x.mp4", "/merged/a b/x.mp4", "/merged/b/y.mp4"}
    assert FO._taken(listing, roots.limit(0), "target", "__t").count() == 0


def test_stored_alone_keeps_the_rows_and_the_setting(spark):
    before = spark.conf.get(skew._CLEANUP)
    rows = skew.store_alone(spark.range(1000).repartition(7, "id"))
    assert rows.count() == 1000 and spark.conf.get(skew._CLEANUP) == before
