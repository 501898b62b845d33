"""Library operators on small hand-made tables: nulls, ties, edges, empties."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from lumenlake.functions import exprs
from lumenlake.operators import analytics, cluster, collections, dedupe, jobs, planning, reconcile, related, search
from lumenlake.plans import questions
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 5, 1)


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


# Expressions


def test_live_is_null_safe(spark):
    df = spark.createDataFrame([("DELETED",), ("NEW",), (None,)], "a string")
    assert sorted((r["a"] or "" for r in df.where(exprs.live(F.col("a"))).collect())) == ["", "NEW"]


def test_rounding_goes_half_upwards(spark):
    assert values(spark, exprs.half_up(F.lit(-2.5)), exprs.half_up(F.lit(2.5)), exprs.percentage(F.lit(1), F.lit(0)), exprs.percentage(F.lit(1), F.lit(3))) == [-2, 3, 100.0, 33.3]


def test_geo_cells_at_their_borders(spark):
    cells = [exprs.geo_cell(F.lit(x).cast("decimal(9,4)")) for x in ("0.05", "-0.05", "-0.15", "47.349", "47.35")]
    assert values(spark, *cells) == [1, 0, -1, 473, 474]


@pytest.mark.parametrize(("name", "ext", "kind"), [("a.JPG", "jpg", "photo"), ("b.tar.gz", "gz", "other"), ("c", "", "other"), ("d.mp4", "mp4", "video"), (".bashrc", "bashrc", "other"), ("x.pdf", "pdf", "document"), ("y.flac", "flac", "audio"), ("z.mts", "mts", "video"), ("k.key", "key", "document"), ("r.CR3", "cr3", "photo"), ("o.opus", "opus", "audio")])
def test_extensions_and_types(spark, name, ext, kind):
    e = exprs.extension_of(F.lit(name))
    assert values(spark, e, exprs.media_type(e)) == [ext, kind]


def test_paths(spark):
    p = F.lit("a%b/c\\d")
    assert values(spark, exprs.slashed(p), exprs.top_folder(F.lit("x")), exprs.top_folder(F.lit("x/y")), exprs.under(F.lit("a%b/c"), "a%b"), exprs.under(F.lit("aXb/c"), "a%b")) == ["a%b/c/d", "/", "x", True, False]


def test_vectors_and_sizes(spark):
    one, zero = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert values(spark, exprs.cosine(one, one), exprs.cosine(one, zero), exprs.human_bytes(F.lit(1023)), exprs.human_bytes(F.lit(1536)), exprs.human_bytes(F.lit(5 << 30))) == [1.0, None, "1023 B", "1.5 KB", "5.0 GB"]


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("xywh", v, strict=True)])
    assert values(spark, exprs.box_overlap(box(0, 0, 2, 2), box(1, 0, 2, 2)), exprs.box_overlap(box(0, 0, 1, 1), box(5, 5, 1, 1)), exprs.box_overlap(box(0, 0, 0, 0), box(0, 0, 0, 0))) == [pytest.approx(1 / 3), 0.0, 0.0]


# Analytics


def test_totals_of_nothing(spark):
    df = spark.createDataFrame([], "size_bytes long, media_type string")
    assert tuple(analytics.totals(df).first()) == (0, 0)
    assert analytics.type_breakdown(df).count() == 0


def test_folder_tree_leaves_root_files_out(spark):
    df = spark.createDataFrame([("root.txt",), ("a/b/c.txt",), ("a/d.txt",), (None,)], "p string")
    assert sorted(tuple(r) for r in analytics.folder_tree(df, "p").select("folder", "depth", "parent", "n_files").collect()) == [("a", 1, None, 2), ("a/b", 2, "a", 1)]


def test_pages_are_clamped(spark):
    df = spark.range(300)
    assert [r[0] for r in analytics.page(df, [F.col("id")], 2, 50).collect()] == list(range(50, 100))
    assert analytics.page(df, [F.col("id")], 0, 1_000).count() == 200
    assert [r[0] for r in analytics.keyset_page(df, "id", 290, 5).collect()] == [291, 292, 293, 294, 295]


def test_zero_filled_histogram(spark):
    counts = analytics.histogram(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k")
    assert dict(analytics.zero_filled(counts, "k", ["a", "b"]).collect()) == {"a": 2, "b": 0}


def test_facets_without_parameters_keep_all(spark):
    df = spark.createDataFrame([("A1.txt", "x/A1.txt", "document", "txt", 5), ("b_2.TXT", "y/b_2.TXT", "document", ".TXT", None)], "name string, relative_path string, media_type string, extension string, size_bytes long")
    assert df.where(analytics.facet()).count() == 2
    assert df.where(analytics.facet(name_like="a_")).count() == 1  # the wildcard counts
    assert df.where(analytics.facet(extensions=["TXT"])).count() == 2
    assert df.where(analytics.facet(least=0)).count() == 1


def test_empty_folders(spark):
    folders = spark.createDataFrame([("a",), ("a/b",), ("c",), ("c/d",)], "folder string")
    files = spark.createDataFrame([("a/b/x.txt",)], "relative_path string")
    assert sorted(r[0] for r in analytics.empty_folders(folders, files).collect()) == ["c", "c/d"]


def test_archive_categories_at_their_thresholds(spark):
    kinds = {"i": "image", "v": "video", "d": "document", "a": "archive", "s": "software", "o": "other", "x": "unheard of"}
    mixes = {
        1: ("i" * 11 + "v" * 9, "General"),  # .55 is not over .55, and the commonest has .4 or more
        2: ("i" * 12 + "v" * 8, "Photo Archive"),
        3: ("a" * 5 + "i" * 15, "Photo Archive"),
        4: ("a" * 6 + "i" * 14, "Nested Archives"),
        5: ("v" * 9 + "o" * 11, "General"),
        6: ("v" * 10 + "o" * 10, "Video Archive"),
        7: ("d" * 10 + "x" * 10, "Document Backup"),
        8: ("s" * 7 + "o" * 13, "General"),
        9: ("s" * 8 + "o" * 12, "Software"),
        10: ("i" * 7 + "v" * 7 + "d" * 6, "Mixed"),
        11: ("i" * 8 + "v" * 7 + "d" * 5, "General"),
    }
    rows = [(k, kinds[c], 1, False, False) for k, (m, _) in mixes.items() for c in m] + [(12, "image", 5, True, False), (13, "image", 5, False, True), (11, "archive", 4, True, False)]
    df = spark.createDataFrame(rows, "a int, kind string, size long, folder boolean, locked boolean")
    found = {r["a"]: r["category"] for r in analytics.archive_mix(df, "a", "kind", "size", "folder", "locked").collect()}
    assert found == {k: c for k, (_, c) in mixes.items()} | {12: "Unknown", 13: "Password Protected"}


def test_sort_keys_are_a_whitelist(spark):
    rows = [(1, "b", 5, DAY, DAY), (2, "a", 9, None, DAY + dt.timedelta(1)), (3, "c", 1, DAY + dt.timedelta(2), None)]
    df = spark.createDataFrame(rows, "id int, name string, size_bytes long, modified_at timestamp_ntz, indexed_at timestamp_ntz")
    order = lambda k: [r["id"] for r in df.orderBy(*analytics.sort_order(k)).collect()]
    assert [order(k) for k in ("name_asc", "name_desc", "size_asc", "size_desc", "modified_asc", "modified_desc")] == [[2, 1, 3], [3, 1, 2], [3, 1, 2], [2, 1, 3], [1, 3, 2], [2, 3, 1]]
    assert order(None) == order("id; drop table_asc") == order("name") == [3, 2, 1]


def test_folder_sizes(spark):
    df = spark.createDataFrame([("a/x/1", 1), ("a/x/2", 2), ("a/x/y/3", 4), ("a/f", 8), ("ab/z", 16), ("r", 32)], "relative_path string, size_bytes long")
    found = {r["name"]: (r["is_folder"], r["size"], r["children"]) for r in analytics.folder_sizes(df, "a").collect()}
    assert found == {"x": (True, 7, 3), "f": (False, 8, None)}
    assert {r["name"]: r["size"] for r in analytics.folder_sizes(df).collect()} == {"a": 15, "ab": 16, "r": 32}


@pytest.mark.parametrize(("online", "reports"), [("1", 0), ("10", 0), ("101", 0), ("100", 1), ("1000", 1), ("1001001", 2), ("00", 1)])
def test_two_failures_in_a_row(spark, online, reports):
    df = spark.createDataFrame([("h", i, c == "1") for i, c in enumerate(online)], "host string, i int, online boolean")
    assert analytics.consecutive_failures(df, "host", ["i"], ~F.col("online")).count() == reports


# Duplicates


FILES = "id int, relative_path string, size_bytes long, content_hash string, quick_fingerprint string"


def test_groups_and_waste(spark):
    rows = [(1, "a", 10, "h", "f1"), (2, "b", 14, "h", "f1"), (3, "c", 13, "h", "f2"), (4, "d", 5, None, "f3"), (5, "e", 5, None, "f3"), (6, "f", 5, "k", "f4"), (7, "g", 5, None, "f4"), (8, "h", 5, "m", "f5"), (9, "i", 5, "n", "f5")]
    df = spark.createDataFrame(rows, FILES)
    assert [tuple(r) for r in dedupe.exact_groups(df).select("n", "wasted", "mean_wasted").collect()] == [(3, 28, 25)]
    # One hash and no other: f1 is exact, f4 has one hash and a null. Nulls only, or two hashes: alike.
    assert {r["quick_fingerprint"] for r in dedupe.fingerprint_groups(df).collect()} == {"f3", "f5"}
    assert tuple(dedupe.summary(df.limit(0)).first()) == (0, 0)
    report = [(r["kind"], r["members"]) for r in dedupe.report(df).orderBy(F.desc("wasted"), "kind", "group_key").collect()]
    assert report == [("EXACT", "1,2,3"), ("FINGERPRINT", "4,5"), ("FINGERPRINT", "8,9")]


def test_fingerprints_read_64_kib_of_either_end(spark):
    one = lambda t: values(spark, exprs.fingerprint(F.lit(len(t)), F.lit(t)))[0]
    text = "a" * 150_000
    assert one("ab" * 5_000) != one("ab" * 2_500 + "ba" + "ab" * 2_499)
    assert one(text) == one(text[:70_000] + "b" + text[70_001:]) and one(text) != one(text[:-1] + "b") and one(text) != one("b" + text[1:])


@pytest.mark.parametrize(("preset", "keeper"), [("oldest", 2), ("newest", 3), ("highest_res", 4), ("shortest_path", 5)])
def test_keepers(spark, preset, keeper):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [
        (1, "a/b/c", "h", None, day(3), day(9), 100, 10),
        (2, "a/b/cc", "h", None, day(2), day(8), 100, 10),  # created before all others
        (3, "a\\b/c", "h", day(5), None, day(10), None, 90),  # modified last
        (4, "a/b/d", "h", day(4), day(1), None, 50, 30),  # taken on day 4, which counts before created on day 1
        (5, "longer-than-all-others", "h", None, None, None, None, None),
        (6, "x", "alone", None, day(0), None, 1, 1),
        (7, "y", None, None, day(0), None, 1, 1),
    ]
    df = spark.createDataFrame(rows, "id int, relative_path string, content_hash string, date_taken timestamp_ntz, date_created timestamp_ntz, modified_at timestamp_ntz, width int, height int")
    found = dedupe.keep_one(df, preset).collect()
    assert {r["id"] for r in found} == {1, 2, 3, 4, 5} and {r["keep_id"] for r in found} == {keeper}
    with pytest.raises(ValueError):
        dedupe.keep_one(df, "largest")


def test_queue_keeps_the_latest_entry(spark):
    rows = [("g", 1, "2024-01-01"), ("g", 2, "2024-01-02"), ("k", 5, "2024-01-01"), ("k", 4, "2024-01-01"), ("z", 9, "2024-01-01")]
    entries = spark.createDataFrame(rows, "group_hash string, saved long, added_at string")
    assert tuple(dedupe.queue_savings(dedupe.queue(entries)).first()) == (3, 16)
    left = dedupe.queue(entries, spark.createDataFrame([("z",), ("q",)], "group_hash string"))
    assert left.columns == entries.columns and tuple(dedupe.queue_savings(left).first()) == (2, 7)
    assert tuple(dedupe.queue_savings(entries.limit(0)).first()) == (0, 0)


def test_restoring_from_the_trash(spark):
    trash = spark.createDataFrame([("t1", "a", DAY), ("t2", "b", DAY - dt.timedelta(1)), ("t3", "c", None), ("t4", "d", DAY)], "trash_path string, original_path string, expires_at timestamp_ntz")
    found = dedupe.restorable(trash, spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",), ("t9",)], "trash_path string"), spark.createDataFrame([("d",)], "path string"), F.lit(DAY).cast("timestamp_ntz"))
    assert {r["trash_path"]: r["state"] for r in found.collect()} == {"t1": "ok", "t2": "expired", "t3": "ok", "t4": "occupied", "t9": "unknown"}


def test_trash_expires_strictly(spark):
    df = spark.createDataFrame([(DAY,), (DAY - dt.timedelta(seconds=1),), (None,)], "expires_at timestamp_ntz")
    assert [r["expired"] for r in dedupe.expired(df, F.lit(DAY).cast("timestamp_ntz")).collect()] == [False, True, False]


# Snapshots


SNAP = "relative_path string, size_bytes long, quick_fingerprint string"


def test_reconciliation(spark):
    stored = [("same", 1, "a"), ("size", 1, "b"), ("gone", 1, "c"), ("old", 1, "d"), ("twin1", 1, "t"), ("twin2", 1, "t"), ("copy", 1, "k"), ("nofp", 1, None), ("out/x", 1, "o")]
    listed = [("same", 1, "a"), ("size", 2, "b2"), ("new", 1, "n"), ("moved", 1, "d"), ("w1", 1, "t"), ("w2", 1, "t"), ("w3", 1, "t"), ("copy", 1, "k"), ("copy2", 1, "k"), ("nofp2", 1, None)]
    a, b = spark.createDataFrame(listed, SNAP), spark.createDataFrame(stored, SNAP)
    found = {r["relative_path"]: (r["action"], r["from_path"]) for r in reconcile.reconcile(a, b).collect()}
    assert found == {"same": ("UNCHANGED", None), "size": ("MODIFIED", None), "gone": ("DELETED", None), "new": ("NEW", None), "moved": ("MOVED", "old"), "w1": ("MOVED", "twin1"), "w2": ("MOVED", "twin2"), "w3": ("NEW", None), "copy": ("UNCHANGED", None), "copy2": ("NEW", None), "nofp": ("DELETED", None), "nofp2": ("NEW", None), "out/x": ("DELETED", None)}
    assert {r["action"] for r in reconcile.reconcile(a, b.limit(0)).collect()} == {"NEW"}
    kept = {r["relative_path"]: r["from_path"] for r in reconcile.reconcile(a, b, all_stored=True).where("action = 'MOVED'").collect()}
    assert kept["copy2"] == "copy" and reconcile.reconcile(a, b, all_stored=True).where("relative_path = 'copy'").first()["action"] == "UNCHANGED"
    assert {r["action"] for r in reconcile.reconcile(a, b, full=True).where("relative_path = 'same'").collect()} == {"MODIFIED"}
    assert {r["relative_path"] for r in reconcile.reconcile(a.limit(0), b, root="out").collect()} == {"out/x"}
    assert {r["action"] for r in reconcile.reconcile(a, b.limit(0)).collect()} == {"NEW"}


def test_merge_protects_columns(spark):
    old = spark.createDataFrame([(1, "a", "t1", 5), (2, "b", "t2", 6)], "id int, name string, thumb string, keep int")
    new = spark.createDataFrame([(1, "A", None), (3, "c", "t3")], "id int, name string, thumb string")
    found = sorted(tuple(r) for r in reconcile.merge(new, old, ["id"], ["name"], ["thumb"]).collect())
    assert found == [(1, "A", "t1", 5), (2, "b", "t2", 6), (3, "c", "t3", None)]


def test_updates_by_join(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, name string")
    names = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, new string")
    assert [r["id"] for r in reconcile.update_where_distinct(rows, names, ["id"], "name", "new").collect()] == [2]
    ids = spark.createDataFrame([(1,), (1,)], "id int")
    assert sorted((r["id"], r["name"]) for r in reconcile.set_where(rows, ids, "id", "name", F.lit("gone")).collect() if r["name"]) == [(1, "gone"), (3, "z")]
    bridge = spark.createDataFrame([(1, 1), (1, 2)], "c int, m int")
    assert reconcile.insert_missing(bridge, spark.createDataFrame([(1, 2), (1, 3)], "c int, m int"), ["c", "m"]).count() == 3


def test_folders_and_integrity(spark):
    now = spark.createDataFrame([("a/x", 5), ("a/y", 7), ("r", 1)], "relative_path string, modified_at int")
    before = spark.createDataFrame([("a/x", 5), ("r", 1), ("b/z", 1)], "relative_path string, modified_at int")
    changed = reconcile.changed_folders(reconcile.directory_state(now), reconcile.directory_state(before))
    assert sorted(r["folder"] for r in changed.collect()) == ["a", "b"]
    indexed = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0), ("d", 3)], "relative_path string, size_bytes long")
    listed = spark.createDataFrame([("a", 5), ("b", 0), ("c", 0)], "relative_path string, size_bytes long")
    assert tuple(reconcile.integrity(indexed, listed).first()) == (1, 1)


# Clusters


def test_sequential_clusters(spark):
    rows = [("k", 1, [1.0, 0.0]), ("k", 2, [0.9, 0.1]), ("k", 3, [0.0, 1.0]), ("k", 4, [0.1, 0.9]), ("j", 5, [0.0, 1.0])]
    found = {r["id"]: r["cluster"] for r in cluster.sequential(spark.createDataFrame(rows, "lib string, id long, v array<double>"), "lib", "id", "v", 0.9).collect()}
    assert found == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}


def test_one_long_sequence_streams_through_batches(spark):
    """Thousands of vectors of one library, and some of others, in batches of a hundred: the same as one by one."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 8))
    rows = [("one" if i % 9 else None, i, (middles[rng.integers(40)] + rng.normal(size=8) * 0.5).tolist()) for i in range(3_000)] + [("one", 9_000, None), ("z", 1, [0.0] * 8)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        table = spark.createDataFrame(rows, "lib string, id long, v array<double>").repartition(6)
        found = {(r["lib"], r["id"]): r["cluster"] for r in cluster.sequential(table, "lib", "id", "v", 0.8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, sums = {}, {}
    for lib, i, v in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1]):
        known, x = sums.setdefault(lib, []), np.array(v)
        sims = [s @ x / ((np.linalg.norm(s) * np.linalg.norm(x)) or 1) for s in known]
        best = int(np.argmax(sims)) if sims else -1
        if best < 0 or sims[best] < 0.8:
            best = len(known)
            known.append(np.zeros(8))
        known[best] = known[best] + x
        want[lib, i] = best
    assert found == want and max(want.values()) > 20


def test_batch_assignment_at_the_threshold(spark):
    centers = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "label int, centroid array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, -1.0])], "id int, v array<double>")
    found = {r["id"]: r["label"] for r in cluster.assign(rows, centers, "id", "v", "label").collect()}
    assert found == {1: 1, 2: 1, 3: None}


def test_merge_and_covers(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.9), (3, 2, 0.9), (4, 3, None)], "id int, person int, score double")
    covers = {r["person"]: r["cover_id"] for r in cluster.covers(cluster.merge(rows, "person", 2, 1), "person", "id", "score").collect()}
    assert covers == {1: 2, 3: 4}


def test_overlapping_boxes_are_suppressed(spark):
    rows = [("i", 0.0, 0.0, 2.0, 2.0, 0.9), ("i", 0.1, 0.0, 2.0, 2.0, 0.8), ("i", 9.0, 9.0, 1.0, 1.0, 0.1), ("j", 0.0, 0.0, 2.0, 2.0, 0.2)]
    found = cluster.suppressed(spark.createDataFrame(rows, "img string, x double, y double, w double, h double, score double"), "img")
    assert sorted(r["score"] for r in found.collect()) == [0.1, 0.2, 0.9]


def test_nearest_with_ties(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    assert [r["id"] for r in cluster.nearest(rows, [1.0, 0.0], "id", "v", 3).collect()] == [1, 3, 2]


# Search


def test_words_and_loose_intents():
    found = search.parse_words("Find my OLD cat a photo of one two three four five")
    assert found.keywords == ("find", "old", "cat", "photo", "one", "two", "three", "four") and found.semantic_query.startswith("Find my OLD")
    raw = {"keywords": ["Cat", 5, " "], "mediaTypes": ["image", "photo", "spaceship"], "dateFrom": "2024-01-01", "dateTo": "soon", "favoriteOnly": "yes", "location": " ", "semanticQuery": " cats "}
    found = search.validated(raw)
    assert (found.keywords, found.media_types, found.date_from, found.date_to, found.favorite_only, found.location, found.semantic_query) == (("cat", "5"), ("image",), "2024-01-01", None, False, None, "cats")
    assert len(search.validated({"keywords": ["w"] * 30}).keywords) == 10
    merged = search.with_filters(found, {"mediaTypes": ["photo"], "favoriteOnly": True, "dateFrom": "x", "dateTo": "2024-02-01"})
    assert (merged.media_types, merged.favorite_only, merged.date_from, merged.date_to) == (("photo",), True, "2024-01-01", "2024-02-01")
    assert search.with_filters(found, {"mediaTypes": []}) == found


def test_hints():
    assert len(search.hints(search.Intent())) == 2
    asked = search.Intent(date_to="2024-01-01", exclude=("x",), media_types=("video",), objects=("a", "b"), location="Rome", favorite_only=True)
    assert [h.split()[0] for h in search.hints(asked)] == ["Remove", "Search", "Stop", "Try"]
    assert search.hints(search.Intent(media_types=("video", "image"), objects=("a",), location="Rome")) == ['Drop the location "Rome" — many files have no GPS data']


ROWS = "id int, name string, relative_path string, description string, user_description string, notes string, ocr_text string, doc_type string, scene string, place_name string, tags array<string>, hidden_tags array<string>, user_tags array<string>, objects array<string>, people array<string>, lat double, date_taken timestamp_ntz, favorite boolean, sim double"
PLAIN = dict.fromkeys((c.split()[0] for c in ROWS.split(", ")))


def media_rows(spark, *rows):
    return spark.createDataFrame([tuple((PLAIN | {"name": "", "relative_path": "", "favorite": False, "id": i} | r).values()) for i, r in enumerate(rows, 1)], ROWS)


def test_scores_confidence_and_reasons(spark):
    cat = search.Intent(keywords=("cat",))
    rows = media_rows(spark, {"name": "Cat.jpg", "notes": "cat"}, {"notes": "my Cat", "ocr_text": "cat"}, {"ocr_text": "CAT"}, {"scene": "cat"}, {"user_tags": ["Cat"]}, {"tags": ["Cat"], "hidden_tags": ["cAT"]}, {"description": "cat", "user_description": "dog"}, {"people": ["Catherine"]})
    found = {r["id"]: (r["score"], r["confidence"], r["reasons"]) for r in search.scored(rows, cat).collect()}
    assert found == {1: (1.0, "possible", 'Name contains "cat"'), 2: (1.0, "possible", 'Your note mentions "cat"'), 3: (0.9, "possible", 'Text mentions "cat"'), 4: (0.4, "possible", ""), 5: (0.4, "possible", ""), 8: (0.4, "possible", "")}
    assert search.scored(rows, search.Intent()).count() == 8
    assert {r["id"] for r in search.scored(rows, search.Intent(exclude=("cat",))).collect()} == {6, 7}


def test_scores_of_objects_places_and_meaning(spark):
    asked = search.Intent(objects=("dog",), location="Rome", doc_types=("bill",), favorite_only=True, date_from="2020-01-01", semantic_query="q")
    rows = media_rows(
        spark,
        {"objects": ["Dogs"], "place_name": "Rome, Italy", "doc_type": "bill", "favorite": True, "date_taken": DAY, "sim": 0.45},
        {"scene": "dog", "relative_path": "rome/x", "sim": 0.30},
        {"lat": 1.0, "sim": 0.29},
        {"lat": 1.0, "sim": 0.1},
        {"lat": 1.0},
        {"sim": -0.5},
    )
    found = {r["id"]: (r["score"], r["confidence"], r["reasons"]) for r in search.scored(rows, asked).collect()}
    assert found == {
        1: (5.85, "very_likely", f"Strong content match; Dog detected; Taken in Rome, Italy; Taken {DAY:%b %Y}; Classified as bill"),
        2: (2.6, "very_likely", 'Related content; Mentions "dog"; Location matches Rome'),
        3: (0.97, "possible", "Has GPS data"),
        5: (0.1, "possible", "Has GPS data"),
    }


def test_similar_items_skip_copies(spark):
    files = spark.createDataFrame([(1, "photo", "h"), (2, "photo", "h"), (3, "photo", "k"), (4, "video", "m"), (5, "photo", None), (6, "photo", "z")], "id int, media_type string, content_hash string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3, 4)] + [(5, [1.0, 1.0]), (6, [-1.0, 0.0]), (7, None)], "id int, embedding array<double>")
    assert [(r["id"], r["confidence"], r["reason"]) for r in search.similar(files, vectors, 1).collect()] == [(3, "very_likely", "100% similar content"), (5, "very_likely", "71% similar content"), (6, "possible", "-100% similar content")]


def test_saved_searches_and_history(spark):
    at = lambda n: F.lit(DAY + dt.timedelta(n)).cast("timestamp_ntz")
    saved = spark.createDataFrame([], "id long, name string, query string, intent string, created_at timestamp_ntz, last_used_at timestamp_ntz")
    saved = search.save_search(saved, " cats ", "old cats", None, at(0))
    saved = search.save_search(saved, "dogs", "dogs", search.Intent(objects=("dog",), date_from="2020-01-01"), at(1))
    assert [(r["id"], r["name"]) for r in saved.orderBy("id").collect()] == [(1, "cats"), (2, "dogs")]
    assert search.rerun_search(saved, 1) == search.parse_words("old cats") and search.rerun_search(saved, 2) == search.Intent(objects=("dog",), date_from="2020-01-01")
    with pytest.raises(LookupError):
        search.rerun_search(saved, 9)
    with pytest.raises(ValueError):
        search.save_search(saved, " ", "x", None, at(2))
    log = spark.createDataFrame([], "id long, query string, results long, created_at timestamp_ntz")
    for n in range(4):
        log = search.log_search(log, f"q{n}", n, at(n), keep=3)
    assert [r["query"] for r in log.orderBy("id").collect()] == ["q1", "q2", "q3"]


def test_suggestions_and_tags(spark):
    df = spark.createDataFrame([("Brown fox", ["Bread", "x"]), ("brick", None), (None, ["abroad"])], "t string, a array<string>")
    assert [r[0] for r in search.suggest([F.col("t"), F.col("a")], [df, df], " BR ").collect()] == ["abroad", "bread", "brick", "brown fox"]
    assert [r[0] for r in search.suggest([F.col("t")], [df], " b ").collect()] == list(search.STARTERS) == [r[0] for r in search.suggest([F.col("t")], [df], None).collect()]
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    assert values(spark, search.effective_tags(arr("Cat", "dog"), arr("CAT"), arr("pet", "dog")), search.effective_tags(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), arr("x"))) == [["dog", "pet", "dog"], ["x"]]
    assert values(spark, *search.edit_tags(arr("Cat"), arr(), arr("cat", "own"), remove="cat")) == [["cat"], ["own"]]
    assert values(spark, *search.edit_tags(arr("Cat"), arr("cat"), arr("own"), add="CAT")) == [[], ["own"]]
    assert values(spark, *search.edit_tags(arr(), arr(), arr(), add="new")) == [[], ["new"]]


def test_embedding_text(spark):
    assert values(spark, search.embedding_text([F.lit(" a "), F.lit(""), F.lit(None).cast("string"), F.lit("b" * 3_000), F.lit("c" * 3_000)], cut_at=(4,))) == [" a \n" + "b" * 3_000 + "\n" + "c" * 2_000]


# Collections


def test_rules_are_salvaged_by_field(spark):
    rule = collections.SmartRule.salvage({"mediaTypes": ["photo", 3], "minSizeBytes": "many", "maxSizeBytes": 9, "nameContains": "", "favoritesOnly": 1, "dateTo": "2024-05-01"})
    assert rule == collections.SmartRule(media_types=("photo",), max_size=9, date_to="2024-05-01")
    rows = [(1, "photo", "a.jpg", 9, DAY), (2, "photo", "b.jpg", 9, DAY + dt.timedelta(seconds=1)), (3, "photo", "c.jpg", None, DAY), (4, None, "d", 1, DAY)]
    df = spark.createDataFrame(rows, "id int, media_type string, name string, size_bytes long, taken timestamp_ntz")
    assert [r["id"] for r in df.where(rule.predicate(F.col("taken"))).collect()] == [1]
    assert df.where(collections.SmartRule().predicate()).count() == 4


def test_document_categories_in_order(spark):
    names = {"Rechnung Bank.pdf": "receipts", "bill.txt": "receipts", "billboard.txt": "other", "User Guide.doc": "manuals", "W2.pdf": "finance", "w-2.xls": "finance", "x.PDF": "pdf", "x.ods": "spreadsheets", "x.key": "presentations", "contract.odt": "other"}
    df = spark.createDataFrame([(n, n.rpartition(".")[2]) for n in names], "n string, e string")
    assert [r[0] for r in df.select(collections.doc_category(F.col("n"), F.col("e"))).collect()] == list(names.values())
    assert values(spark, collections.doc_category(F.lit("x.txt"), F.lit(None).cast("string"), F.lit("Steuer"), F.lit(None).cast("string")), collections.doc_category(F.lit("x"), F.lit("txt"), F.lit(None).cast("string"), F.lit("Handbuch"))) == ["finance", "manuals"]


def test_groups_have_names(spark):
    number = lambda x: F.lit(x).cast("decimal(9,4)")
    none = F.lit(None).cast("string")
    found = values(spark, collections.month_group(F.lit(DAY).cast("timestamp_ntz")), collections.place_group(number("46.94"), number("-7.05"), none), collections.place_group(number("47.02"), number("8.5"), F.lit("Zug")), collections.place_group(number("-0.04"), F.lit(None).cast("decimal(9,4)"), none), collections.doc_group(F.lit("pdf")))
    assert [tuple(x) if x else None for x in found] == [
        (f"event:{DAY:%Y-%m}", f"{DAY:%B %Y}", f"Photos & videos from {DAY:%B %Y}"),
        ("place:46.9,-7", "Around 46.9°N, 7.0°W", "Media taken near this location"),
        ("place:47,8.5", "Zug", "Media taken in and around Zug"),
        None,
        ("doc:pdf", "PDFs", "All PDF documents"),
    ]


def test_rebuild_differences(spark):
    old = [("a", "Mine", False, 1), ("b", "Around 1,2", False, None), ("c", "Dead", True, 3), ("d", "Gone", False, 4), ("e", "Around x", False, 5), ("g", "Around z", False, 6)]
    new = [("a", "Auto", 9), ("b", "Zurich", 8), ("c", "Back", 7), ("f", "Fresh", 6), ("e", "Around y", 5), ("g", "Around z", 2)]
    e, g = spark.createDataFrame(old, "auto_key string, name string, removed boolean, cover_id long"), spark.createDataFrame(new, "auto_key string, name string, cover_id long")
    found = {r["auto_key"]: tuple(r)[1:] for r in collections.difference(e, g).collect()}
    assert found == {"a": ("keep", "Mine", 1), "b": ("rename", "Zurich", 8), "c": ("skip", "Dead", 3), "d": ("delete", "Gone", 4), "e": ("rename", "Around y", 5), "f": ("create", "Fresh", 6), "g": ("keep", "Around z", 6)}
    keyed = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("f", 6), ("e", 5), ("g", 2), ("g", 2), ("h", 1)], "auto_key string, id long")
    covers = {r["auto_key"]: r["cover_id"] for r in collections.difference(e, g, keyed).collect()}
    assert (covers["a"], covers["e"], covers["g"]) == (9, 5, 2)
    assert sorted(map(tuple, collections.rebuilt_members(keyed, g, e).collect())) == [("a", 9), ("b", 8), ("e", 5), ("f", 6), ("g", 2)]


def test_auto_groups_reach_their_least(spark):
    keyed = spark.createDataFrame([("event:2024-01", "J", "", i) for i in range(3)] + [("event:2024-02", "F", "", i) for i in range(2)] + [("doc:receipts", "R", "", 9), (None, None, None, 1)], "auto_key string, name string, description string, id long")
    assert {r["auto_key"]: (r["name"], r["n"], r["cover_id"]) for r in collections.auto_groups(keyed).collect()} == {"event:2024-01": ("J", 3, 2), "doc:receipts": ("R", 1, 9)}


def test_places(spark):
    places = spark.createDataFrame([(1, 47.31, 8.5, "x"), (2, 47.32, 8.51, "Zurich"), (3, None, 1.0, "y"), (4, 10.0, 10.0, None)], "id int, lat double, lon double, name string")
    cache = spark.createDataFrame([(473, 85, "Zurich"), (0, 0, None)], "lat10 int, lon10 int, name string")
    assert [tuple(r) for r in collections.uncached_cells(places, cache).collect()] == [(100, 100)]
    assert [r["id"] for r in collections.place_changes(places, cache).collect()] == [1]


# Related items


def test_collections_and_neighbours(spark):
    bridge = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 7), (2, 9), (3, 5)] + [(1, i) for i in range(100, 120)], "c int, m int")
    found = related.same_collection(bridge, 7, "c", "m").collect()
    assert len([r for r in found if r["c"] == 1]) == 12 and {r["m"] for r in found if r["c"] == 2} == {9}
    items = spark.createDataFrame([(1, 1, "k"), (2, 1, "k"), (3, 2, "k"), (4, 3, "k"), (5, None, "k")], "id int, t int, key string")
    assert {r["id"]: (r["prev_id"], r["next_id"]) for r in related.neighbours(items.where("t is not null"), "t", "id", "key").collect()} == {1: (None, 3), 2: (None, 3), 3: (2, 4), 4: (3, None)}


def test_best_rows_and_pending(spark):
    rows = spark.createDataFrame([("f", 1, 0.5), ("f", 2, 0.5), ("g", 3, None), ("g", 4, 0.1)], "file string, id int, score double")
    assert {r["file"]: r["id"] for r in related.best_per_group(rows, "file", "score", "id").collect()} == {"f": 1, "g": 4}
    done = spark.createDataFrame([(1, 2), (2, 1), (None, 5)], "id int, v int")
    assert [r["id"] for r in related.pending(spark.createDataFrame([(1,), (2,), (3,)], "id int"), done, "id", "v", 2).orderBy("id").collect()] == [2, 3]


# Planning


def test_routes_and_conflicts(spark):
    files = spark.createDataFrame([(1, "a.jpg", "photo", 1, None), (2, "a.jpg", "photo", 2, " "), (3, "a.jpg", "photo", 3, "Mine"), (4, "x.bin", "zip", 4, None)], "id int, name string, media_type string, size_bytes long, own string")
    routes = planning.routed(files, {"photo": "Photos"}, override=F.col("own"))
    assert [r["dest_path"] for r in routes.orderBy("id").collect()] == ["Photos/a.jpg", "Photos/a.jpg", "Mine/a.jpg", "Other/x.bin"]
    existing = spark.createDataFrame([("Photos/a.jpg",), ("Other/x.bin",)], "dest_path string")
    assert [r["conflict"] for r in planning.dry_run(routes, existing, ["id"]).orderBy("id").collect()] == ["disk", "intra_job", None, "disk"]
    renamed = [r["dest_path"] for r in planning.renamed(routes, existing, ["id"]).orderBy("id").collect()]
    assert renamed == ["Photos/a_1.jpg", "Photos/a_2.jpg", "Mine/a.jpg", "Other/x_1.bin"]
    assert values(spark, planning.outcome("skip", F.lit(None).cast("string")), planning.outcome("skip", F.lit("disk"))) == ["move", "skip"]
    left = planning.excluded(routes.withColumn("relative_path", F.col("id").cast("string")), ("zip",), spark.createDataFrame([("2",)], "relative_path string"))
    assert {r["id"] for r in left.collect()} == {1, 3}
    assert tuple(planning.same_plan(routes, left).first()) == (4, 2, False)


def test_new_names_leave_out_those_in_use(spark):
    paths = ["d/a.x"] * 4 + ["d/a_2.x", "d/a_2.x", "d/noext", "d/noext", "d.e/f", "d.e/f"]
    routes = spark.createDataFrame(list(enumerate(paths)), "id int, dest_path string")
    existing = spark.createDataFrame([("d/a_1.x",), ("d/a_4.x",), ("d/noext",)], "dest_path string")
    found = [r["dest_path"] for r in planning.renamed(routes, existing, ["id"]).orderBy("id").collect()]
    assert found == ["d/a.x", "d/a_3.x", "d/a_5.x", "d/a_6.x", "d/a_2.x", "d/a_2_1.x", "d/noext_1", "d/noext_2", "d.e/f", "d.e/f_1"]


def test_savings_by_profile(spark):
    files = spark.createDataFrame([(1, "jpg", 1_000), (2, "jpg", 500), (3, "cr2", 100), (4, "odd", 7)], "id int, extension string, size_bytes long")
    found = {r["extension"]: (r["status"], r["n"], r["saving"], r["samples"], r["status_rank"]) for r in planning.savings(files, planning.rules(spark)).collect()}
    assert found == {"jpg": ("convert", 2, 270, "1,2", 0), "cr2": ("protected", 1, 0, "3", 1), "odd": ("skip", 1, 0, "4", 3)}
    told = {p: {r["extension"]: (r["status"], r["target"], r["ratio"]) for r in planning.rules(spark, p, raw=p == "MAXIMUM").collect()} for p in planning.PROFILES}
    assert [told[p]["jpg"] for p in told] == [("protected", "jpg", 0.0), ("convert", "jpg", 0.18), ("convert", "webp", 0.27)]
    assert told["BALANCED"]["cr2"] == ("protected", None, None) and told["MAXIMUM"]["cr2"] == ("convert", "jpg", 0.8) and told["MAXIMUM"]["3fr"][0] == "protected"
    assert len(told["BALANCED"]) == 61


def test_codecs_and_issues(spark):
    pairs = [planning.codec_override(F.lit(c), F.lit("skip"), F.lit(0.4)) for c in ("prores", "v210", "h264", "vp8", "mjpeg", "cinepak", "ffv1")]
    assert values(spark, *[x for p in pairs for x in p]) == ["protected", 0.4, "protected", 0.4, "optimal", 0.4, "optimal", 0.4, "convert", 0.68, "convert", 0.68, "skip", 0.4]
    issues = lambda *x: planning.jpeg_issues(*[F.lit(v) for v in x])
    found = values(spark, issues(False, 6, 100, "4:4:4"), issues(True, 5, 100, "4:2:0"), issues(True, 5, 100, "4:1:1"))
    assert [len(x) for x in found] == [3, 0, 1] and found[2] == ["suboptimal chroma subsampling (4:1:1)"]


def test_more_centroids_than_one_pass_takes(spark):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)], "id long, v array<double>")
    centers = spark.createDataFrame([(c, [rng.gauss(0, 1) for _ in range(4)]) for c in range(30)] + [(30, [0.0] * 4)], "label int, centroid array<double>")
    one, many = (cluster.assign(vectors, centers, "id", "v", "label", 0.5, block_elements=n) for n in (10_000, 20))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr) and one.count() == 60
    assert {f.name: f.dataType.simpleString() for f in one.schema} == {"id": "bigint", "label": "int", "sim": "double"}


def test_first_scans_need_no_fingerprints(spark):
    listing = spark.createDataFrame([("a", 1)], "relative_path string, size_bytes long")
    none, some = (reconcile.with_fingerprints(listing, s, F.lit("f")).first()["quick_fingerprint"] for s in (listing.limit(0), listing))
    assert (none, some) == (None, "f")


def test_errors_leave_what_was_derived(spark):
    rows = spark.createDataFrame([(1, "text", None), (2, "more", None)], "id int, ocr string, error string")
    found = reconcile.record_error(rows, spark.createDataFrame([(2, "boom"), (3, "bad")], "id int, error string"), "id")
    assert sorted(map(tuple, found.select("id", "ocr", "error").collect())) == [(1, "text", None), (2, "more", "boom"), (3, None, "bad")]


def test_inserted_rows_get_the_next_ids(spark):
    rows = spark.createDataFrame([(4, "x")], "id long, name string")
    found = reconcile.inserted(rows, spark.createDataFrame([("b",), ("a",)], "name string"))
    assert sorted(map(tuple, found.collect())) == [(5, "a"), (6, "b")]
    assert [r["id"] for r in reconcile.inserted(rows.limit(0), spark.createDataFrame([("b",)], "name string")).collect()] == [1]


def test_integrity_is_unknown_beyond_its_limit(spark):
    indexed = spark.createDataFrame([("a", 1), ("b", 2)], "relative_path string, size_bytes long")
    assert tuple(reconcile.integrity(indexed, indexed.limit(0), most=1).first()) == (None, None)
    assert tuple(reconcile.integrity(indexed, indexed.limit(0), most=None).first()) == (2, 0)


# Jobs and questions


def test_orders_of_work(spark):
    df = spark.createDataFrame([("b", "mp4", 5, DAY), ("a", "jpg", 9, DAY), ("c", "jpg", 1, None), ("d", "jpg", 2, DAY + dt.timedelta(1)), ("e", "zzz", 1, DAY), ("f", "pdf", 3, DAY)], "p string, ext string, size long, t timestamp_ntz")
    assert [r["p"] for r in df.orderBy(*jobs.index_order(F.col("ext"), F.col("t"), F.col("p"))).collect()] == ["d", "a", "c", "b", "f", "e"]
    assert [r["p"] for r in df.orderBy(jobs.queue_score(F.col("ext"), F.col("size"))).collect()] == ["c", "d", "a", "f", "b", "e"]
    people = spark.createDataFrame([(1, None, 9), (2, "Ann", 1), (3, "Bo", 5), (4, "Cy", 5)], "id int, name string, n int")
    assert [r["id"] for r in people.orderBy(*jobs.people_order(F.col("name"), F.col("n"), F.col("id"))).collect()] == [3, 4, 2, 1]
    dirs = spark.createDataFrame([("z", True), ("a", False), ("b", True)], "name string, d boolean")
    assert [r["name"] for r in dirs.orderBy(*jobs.folders_first(F.col("d"), F.col("name"))).collect()] == ["b", "z", "a"]


def test_job_log(spark):
    rows = [(1, "DONE", DAY, DAY + dt.timedelta(seconds=10), 100, 20 << 20), (2, "DONE", DAY, None, 5, 5), (3, "FAILED", DAY, DAY, 5, 5), (4, "DONE", DAY + dt.timedelta(1), DAY + dt.timedelta(days=1, seconds=5), 100, 0)]
    timed = jobs.throughput(spark.createDataFrame(rows, "id int, status string, started_at timestamp_ntz, finished_at timestamp_ntz, processed_files long, processed_bytes long"))
    found = {r["id"]: (r["files_per_sec"], r["mb_per_sec"]) for r in timed.collect()}
    assert found == {1: (10.0, 2.0), 2: (None, None), 3: (None, None), 4: (20.0, 0.0)}
    assert tuple(jobs.typical(timed).first()) == (15.0, 7.5)
    scans = timed.withColumns({"peak_workers": F.col("id"), "dir_cache": jobs.hit_rate(F.col("id"), F.lit(0))})
    assert [r["id"] for r in jobs.sorted_scans(scans, "filesPerSec").collect()] == [4, 1, 2, 3]
    assert all(jobs.sorted_scans(scans, k, False).count() == 4 for k in jobs.SORT_KEYS)


def test_resumable_touched_and_refreshed(spark):
    log = spark.createDataFrame([(1, "executing", None, DAY), (2, "failed", "copy", DAY), (3, "failed", None, DAY), (4, "done", "copy", DAY)], "id int, status string, last_stage string, created_at timestamp_ntz")
    assert {r["id"] for r in jobs.resumable(log).collect()} == {1, 2}
    files = spark.createDataFrame([(1, "NEW", DAY, DAY, 1, "x"), (2, "NEW", DAY - dt.timedelta(1), DAY, 2, "y"), (3, None, DAY, DAY, None, None)], "id int, last_scan_action string, last_scanned_at timestamp_ntz, modified_at timestamp_ntz, scanner_version int, thumbnail_path string")
    assert [r["id"] for r in jobs.touched(files, "new", F.lit(DAY).cast("timestamp_ntz")).collect()] == [1]
    with pytest.raises(ValueError, match="action"):
        jobs.touched(files, "LOST", F.lit(DAY))
    assert sorted(r["id"] for r in jobs.outdated(files, 2).collect()) == [1, 3]
    fresh = jobs.refreshed(files, spark.createDataFrame([(1, "new"), (2, "no")], "id int, thumbnail_path string"), 2)
    assert sorted((r["id"], r["scanner_version"], r["thumbnail_path"] or "") for r in fresh.collect()) == [(1, 2, "new"), (2, 2, "y"), (3, 2, "")]
    assert [r["id"] for r in jobs.orphans(files, spark.createDataFrame([("x",)], "full_path string")).collect()] == [2]


def test_questions(spark):
    assert questions.understood("Find files named 'holiday'") == questions.Asked("holiday", ())
    assert questions.understood("how much space is wasted on zip archives?").reports == ("storage", "archives", "duplicates")
    assert questions.understood("hello") == questions.Asked(None, ())
    files = spark.createDataFrame([(1, "Holiday.jpg", "photo", 5, "h"), (2, "x", "photo", 5, "h")], "id int, name string, media_type string, size_bytes long, content_hash string")
    assert [r["id"] for r in questions.answers("find holiday", files)["matches"].collect()] == [1]
    assert set(questions.answers("duplicate storage", files)) == {"storage", "largest", "duplicates"}
    assert questions.answers("hello", files) == {}
