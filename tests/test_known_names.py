"""Names that a stream compares once: state of matches by version of the list."""

from pyspark.sql import functions as F

from cargosift.operators import matching as M
from cargosift.sources import readers
from cargosift.streaming import streams

NAMES = ["Blockd Industries Ltd", "BLOCKED INDUSTRIES, LTD.", "Plain Trading", "Prohibitd Tradng Company 3", "", None, "Other Freight", "Sanctioned Holdings"]


def _rows(spark, at):
    return spark.createDataFrame([(str(i), NAMES[i % 8], NAMES[(i * 3) % 8]) for i in at], "id string, consignee string, shipper string")


def _matches(rows):
    return sorted((r.id, r.matches) for r in rows.select("id", "matches").collect())


def test_known_names_match_as_batches_do_and_are_compared_once(spark, tmp_path):
    denied, known = readers.denied_parties(spark), streams.KnownNames(spark, str(tmp_path))
    first, second = _rows(spark, range(0, 3)), _rows(spark, range(0, 40))
    version, n = known.learn(first, denied, 0)
    assert n > 0 and _matches(known.matches(first, version)) == _matches(M.party_matches(first, denied))
    all_names = {r[0] for r in second.select(F.explode(F.array(*[M.E.normal_name(F.col(c)) for c in M.ROLES]))).collect()} - {"", None}
    assert known.learn(second, denied, 1) == (version, len(all_names) - n)
    assert _matches(known.matches(second, version)) == _matches(M.party_matches(second, denied))
    assert known.learn(second, denied, 2) == (version, 0)  # nothing new, nothing compared
    assert known.learn(second, denied, 1) == (version, 0)  # a batch that comes again
    before = sorted(map(tuple, known._known(version).collect()), key=str)
    known.compact(denied)
    assert len(known._parts(version)) == 1 and sorted(map(tuple, known._known(version).collect()), key=str) == before
    assert known.learn(first, denied, 1) == (version, 0) and known.learn(_rows(spark, [7]).withColumn("consignee", F.lit("New Name")), denied, 3) == (version, 1)
    assert _matches(known.matches(second, version)) == _matches(M.party_matches(second, denied))


def test_another_list_begins_anew(spark, tmp_path):
    denied, known = readers.denied_parties(spark), streams.KnownNames(spark, str(tmp_path))
    rows = _rows(spark, range(16))
    version, n = known.learn(rows, denied, 0)
    assert known._list(denied.orderBy(F.desc("ord")).repartition(3)) == version
    fewer = denied.where("ord < 1000")
    other, m = known.learn(rows, fewer, 1)
    assert other != version and m == n
    assert _matches(known.matches(rows, other)) == _matches(M.party_matches(rows, fewer))
    known.expire(fewer)
    assert known._parts(version) == [] and len(known._parts(other)) == 1


def test_empty_batch_and_empty_list(spark, tmp_path):
    denied, known = readers.denied_parties(spark), streams.KnownNames(spark, str(tmp_path))
    none = _rows(spark, range(1)).where("id = 'no'")
    version, n = known.learn(none, denied, 0)
    assert n == 0 and known.matches(none, version).count() == 0
    rows = _rows(spark, range(8))
    version, n = known.learn(rows, denied.where("ord < 0"), 1)
    assert n > 0 and all(m == [] for _, m in _matches(known.matches(rows, version)))


def test_stream_rows_equal_batch_rows(spark, tmp_path):
    denied, known = readers.denied_parties(spark), streams.KnownNames(spark, str(tmp_path / "names"))
    src = str(tmp_path / "in")
    rows = _rows(spark, range(40))
    for part in (rows.where("id < '2'"), rows.where("id >= '2'")):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = streams.parquet_stream(spark, src, rows.schema)
    streams.screen(stream, known, denied, lambda batch, matcher: matcher(batch).select("id", "matches"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert _matches(spark.read.parquet(str(tmp_path / "out"))) == _matches(M.party_matches(rows, denied))
    assert len(known._parts(known._list(denied))) == 2
