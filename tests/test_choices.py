"""Small rows for choices whose rules the queries' inputs meet in part."""

import pytest
from pyspark.sql import functions as F

from reelforge.functions import grid as G
from reelforge.functions import language as L
from reelforge.operators import choice as C
from reelforge.operators import fits as A
from reelforge.operators import journal as J


@pytest.mark.parametrize(
    ("language", "target", "want"),
    [("por", "pt", True), ("pt-BR", "pt", False), ("pt_br", "pt-br", True), ("en-US", "en", True), ("en", "en-us", False), ("zxx.eng", "en", True), ("zxx-en", "en", False), ("es-419", "es", False), (" ", "en", False), (None, "en", False)],
)
def test_code_matches(spark, language, target, want):
    row = spark.createDataFrame([(language, target)], "l string, t string").select(L.track_codes(F.col("l")).alias("c"), L.language_code(F.col("t")).alias("g")).select(L.codes_fit(F.col("c"), F.col("g")).alias("m")).first()
    assert row.m is want


def test_track_variant_needs_one_region(spark):
    rows = [("por", "brasil", "pt-br"), ("pt", "brasil portugal", "pt"), ("spa", "latino", "es-419"), ("spa", "spain", "es"), ("may", "indonesian", "id"), (None, "", "")]
    got = spark.createDataFrame(rows, "l string, w string, want string").select(L.track_variant(F.coalesce(L.language_code(F.col("l")), F.lit("")), F.col("w")).alias("v"), "want").collect()
    assert [r.v for r in got] == [r.want for r in got]


def _choose(spark, tracks, targets, normal=False):
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(tracks)], "k int, ord int, label string, language string, track string, forced boolean")
    g = spark.createDataFrame([(1, i, x) for i, x in enumerate(targets)], "k int, position int, target string")
    return C.chosen_tracks(t, g, ["k"], normal).first().ord


def test_chosen_tracks(spark):
    plain = lambda label, language: (label, language, None, False)
    assert _choose(spark, [("x", "en", None, True), plain("y", "en")], ["en"]) == 1
    assert _choose(spark, [("x", "en", None, True)], ["en"]) == 0
    assert _choose(spark, [("x", "en", None, True)], ["en"], True) is None
    assert _choose(spark, [plain("Brasil", "pt"), plain("z", "en")], ["pt", "en"]) == 1  # the only track is of the other region
    assert _choose(spark, [plain("Portugal", "pt"), plain("Brasil", "pt")], ["pt-br"]) == 1
    assert _choose(spark, [plain("z", "en"), plain("Full", "pt")], ["pt-br", "en"]) is None  # the first target gives up
    assert _choose(spark, [plain("z", "en"), plain("Full", "pt")], ["fr", "pt-br", "en"]) == 0
    assert _choose(spark, [plain("z", "en")], []) is None


def test_journal_forgets_what_was_removed(spark):
    snap = spark.createDataFrame([("a", 1, 5, "A", 7), ("b", 1, 5, "B", 8)], "k string, at int, watched int, title string, tmdb int")
    log = spark.createDataFrame([("a", 2, None, False, None), ("b", 2, None, True, None), ("b", 3, 9, False, None), ("c", 4, 1, False, 3), ("c", 5, 1, True, 3)], "k string, at int, watched int, removed boolean, tmdb int")
    got = {r.k: (r.watched, r.title, r.tmdb) for r in J.applied_journal(snap, log, ["k"], ["at"], ["title"], ["tmdb"]).collect()}
    assert got == {"a": (2, "A", 7), "b": (9, None, None)}


def test_empty_inputs(spark):
    snap = spark.createDataFrame([], "k string, at int, watched int, title string, tmdb int")
    log = spark.createDataFrame([], "k string, at int, watched int, removed boolean, tmdb int")
    assert J.applied_journal(snap, log, ["k"], ["at"], ["title"], ["tmdb"]).count() == 0


def test_step_of_a_cue_without_length(spark):
    row = spark.sql("SELECT 5L AS a, 5L AS b, 5L AS pos, 10L AS delta, 12L AS dur").select(G.step_target(*map(F.col, ("a", "b", "pos", "delta", "dur"))).alias("t")).first()
    assert row.t == 12


def test_a_confident_fit(spark):
    groups = spark.createDataFrame([("p", i, 1, 1, 0.5, float(i)) for i in range(30)], "pair string, target_start int, target_n int, reference_n int, cost double, residual double")
    sizes = spark.createDataFrame([("p", 31, 40)], "pair string, target_size int, reference_size int")
    q = A.fit_quality(groups, sizes, ["pair"]).first()
    assert (q.confident, q.skip_run, q.skipped_reference, q.residual, q.shapes[0]) == (True, 1, 10, 15.0, 30)


def test_marks_are_in_the_name_of_a_file(spark):
    from reelforge.operators import viewing as V

    files = spark.createDataFrame([(1, 0, 0, "Show S01E03/S01E01.mkv", 5, True), (1, 1, 1, "Show S01E03\\S01E03.mkv", 3, True), (1, 2, 2, "b/", 9, True)], "request int, pos int, id int, name string, size long, playable boolean")
    wanted = spark.createDataFrame([(1, ["", " /x"], ["s01e03"], None)], "request int, names array<string>, marks array<string>, index int")
    one = lambda **more: V.chosen_file(files, wanted, ["request"], **more).first()
    assert one().id == 1
    assert one(whole_path=True).id == 0
    names = spark.createDataFrame([(1, ["", "..."], [], None)], "request int, names array<string>, marks array<string>, index int")
    assert V.chosen_file(files, names, ["request"]).first().step == 5


def test_rows_of_active_titles_stay_without_a_seed(spark):
    from reelforge.operators import viewing as V

    rows = spark.createDataFrame([(1, c, 1, 2) for c in "abcd"], "profile int, content string, seed_season int, seed_episode int")
    seeds = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 3)], "profile int, content string, season int, episode int")
    active = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "profile int, content string")
    kept = lambda *more: "".join(sorted(r.content for r in V.current_up_next(rows, seeds, ["profile"], *more).collect()))
    assert kept(False) == "acd"
    assert kept(True, active) == "ac"
    assert kept(True) == "a"


def test_separators_of_files_to_units_are_trimmed(spark):
    from pyspark.sql import functions as F

    from reelforge.functions import text

    assert spark.range(1).select(text.trimmed(F.lit("\x1c\x1f a b \x1e　")).alias("t")).first().t == "a b"
