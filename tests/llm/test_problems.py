"""The training-data operators on small cases: brute force, dirty rows, ties, empty tables."""

import itertools
import os
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import batch_dedup, format_dups, leakage, name_variants, packing, pii, pii_examples, shared_spans, tokenhash, vector_neighbors


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


# words and hashes


def test_words_match_a_plain_split():
    texts = ["One  two\tthree", None, "", "Ünïcode ﬁne ½ x_y z", "İstanbul\r\n" * 3]
    for mode, split in (
        ("blank", lambda t: re.findall(r"[^ \t\r\n]+", t)),
        ("lower", lambda t: re.findall(r"[^\W_]+", t.lower())),
        ("nfkc", lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower())),
    ):
        sizes, hashes = [], {}
        for part in tokenhash.words(texts, mode):
            sizes += np.diff(part.bounds).tolist()
            words = [w for t in texts for w in split(t or "")]
            for w, h in zip(words, part.hashes.tolist()):
                assert hashes.setdefault(w, h) == h
        assert sizes == [len(split(t or "")) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_chunks_do_not_change_hashes(monkeypatch):
    texts = [f"word{i} and some more {i % 7}" for i in range(50)]
    whole = np.concatenate([p.hashes for p in tokenhash.words(texts, "lower")])
    monkeypatch.setattr(tokenhash, "CHUNK_CHARS", 40)
    assert (np.concatenate([p.hashes for p in tokenhash.words(texts, "lower")]) == whole).all()


# 1: similar vectors


def _points(spark, n=400, d=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, d))
    x = np.concatenate([centres[rng.integers(0, len(centres), n // 2)] + 0.3 * rng.normal(size=(n // 2, d)), rng.normal(size=(n - n // 2, d))]).astype(np.float32)
    data = [(i, "ab"[i % 2], d, [float(v) for v in row], "clash") for i, row in enumerate(x)]
    data += [(1000 + i, "a", d, data[0][3], "copy") for i in range(30)]  # a group of copies
    data += [(2000, "a", d, None, ""), (2001, "a", d, [1.0] * 3, ""), (2002, "a", d, [0.0] * d, ""), (2003, "a", d, [float("nan")] * d, ""), (2004, None, d, data[1][3], "")]
    return data, spark.createDataFrame(data, "point_no long, collection_name string, dimension int, vector array<float>, cls string")


def test_similar_vectors_reach_brute_force(spark):
    data, df = _points(spark)
    usable = vector_neighbors.usable_vectors(df)
    got = rows(vector_neighbors.nearest(usable, 10, 0.8), "no", "neighbour_no")
    expected = set()
    good = [r for r in data if r[3] and len(r[3]) == r[2] and np.isfinite(r[3]).all() and any(r[3])]
    for space in {r[1] for r in good}:
        mine = sorted((r for r in good if r[1] == space), key=lambda r: r[0])
        x = np.array([r[3] for r in mine], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cos = np.round(x @ x.T, 9)
        for i, r in enumerate(mine):
            order = sorted((j for j in range(len(mine)) if j != i and cos[i, j] >= 0.8), key=lambda j: (-cos[i, j], mine[j][0]))[:10]
            expected |= {(r[0], mine[j][0]) for j in order}
    assert len(got & expected) >= 0.95 * len(expected)
    assert len(got - expected) <= 0.05 * len(expected)
    asked = usable.filter("no % 20 = 0")
    exact = rows(vector_neighbors.exact_nearest(usable, asked, 10, 0.8), "no", "neighbour_no")
    assert exact == {p for p in expected if p[0] % 20 == 0}


def test_similar_vectors_of_nothing(spark):
    _, df = _points(spark)
    assert vector_neighbors.nearest(vector_neighbors.usable_vectors(df.filter("false"))).count() == 0


def test_a_dense_cluster_is_cut(spark):
    """Two fifths of the rows lie in one cluster, all different; its buckets are cut and its nearest pairs are found."""
    rng = np.random.default_rng(6)
    d, n = 32, 3000
    centre = rng.normal(size=d)
    x = np.concatenate([centre + 0.35 * rng.normal(size=(2 * n // 5, d)) * rng.random((2 * n // 5, 1)), rng.normal(size=(3 * n // 5, d))])
    code = x @ vector_neighbors.learn_rotation(x, 60) > 0
    cut = vector_neighbors.deeper_keys(code, 6, 10, 3000, split=200)
    assert len(cut) == 10 and all((depth >= 1).all() for _, depth in cut.values())
    assert not vector_neighbors.deeper_keys(code, 6, 10, 3000)
    df = spark.createDataFrame([(i, "a", d, [float(v) for v in r]) for i, r in enumerate(x)], "point_no long, collection_name string, dimension int, vector array<float>")
    usable = vector_neighbors.usable_vectors(df)
    exact = rows(vector_neighbors.exact_nearest(usable, usable.filter("no % 20 = 0"), 10, 0.8), "no", "neighbour_no")
    found = rows(vector_neighbors.nearest(usable, 10, 0.8, split=200).filter("no % 20 = 0"), "no", "neighbour_no")
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) > 500


def test_cutting_a_bucket_changes_no_result(spark):
    rng = np.random.default_rng(9)
    d, n = 32, 600
    x = np.concatenate([rng.normal(size=d) + 0.6 * rng.normal(size=(n, d)), rng.normal(size=(n, d))])
    df = spark.createDataFrame([(i, "a", d, [float(v) for v in r]) for i, r in enumerate(x)], "point_no long, collection_name string, dimension int, vector array<float>")
    usable = vector_neighbors.usable_vectors(df)
    code = x @ vector_neighbors.learn_rotation(x, 60) > 0
    assert vector_neighbors.deeper_keys(code, 6, 10, len(x), split=20)
    whole, cut = (rows(vector_neighbors.nearest(usable, 10, 0.8, split=split), "no", "neighbour_no", "rank") for split in (1 << 40, 20))
    assert len(whole) > 4000 and cut == whole


def test_any_two_rows_of_a_bucket_share_a_tile():
    own = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 60)
    for groups in (3, 7):
        tiles = {}
        for at, tile in vector_neighbors._tiles(np.arange(60), own, np.full(60, groups)):
            for r, k in zip(at.tolist(), tile.tolist()):
                tiles.setdefault(k, set()).add(r)
        assert {p for t in tiles.values() for p in itertools.combinations(sorted(t), 2)} == set(itertools.combinations(range(60), 2))
        assert len(tiles) == groups * (groups - 1) // 2


def test_more_rows_take_longer_keys():
    assert vector_neighbors.plan_tables(10_000, 0.8)[0] <= vector_neighbors.plan_tables(10_000_000, 0.8)[0]


# 2: batches against history


def _records():
    base = "the quick brown fox jumps over the lazy dog while nine small birds sing in a tall old tree near the river bank today".split()
    near = base[:-2] + ["bank", "yesterday"]
    far = base[:8] + [f"other{i}" for i in range(16)]
    return [
        (1, 0, "txt", " ".join(base)),
        (2, 0, "txt", " ".join(far)),
        (3, 1, "txt", " ".join(near)),
        (4, 1, "txt", " ".join(base).upper() + "!"),
        (5, 2, "csv", "name: Ann, town: Ghent"),
        (6, 2, "csv", "town: ghent | name: ANN"),
        (7, 2, "txt", None),
        (8, 2, "txt", ""),
        (9, 2, "txt", "two words"),
        (10, 3, "txt", "two words"),
        (11, 3, "md", "entirely different content about packing boxes into a small van before noon on friday"),
    ]


def _fresh(spark, tmp_path, name="store"):
    return batch_dedup.FingerprintStore(spark, str(tmp_path / name), cells=4)


def test_repeats_are_found_with_their_first(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in _records()], "record_no long, batch_no int, extension string, content string, k1 string")
    assert rows(_fresh(spark, tmp_path).match(df), "first_no", "dup_no") == {(1, 3), (1, 4), (5, 6), (9, 10)}
    assert _fresh(spark, tmp_path).match(df.filter("false")).count() == 0


def test_store_matches_batch_after_batch(spark, tmp_path):
    df = spark.createDataFrame(_records(), "record_no long, batch_no int, extension string, content string")
    store, found = _fresh(spark, tmp_path), set()
    for n in range(4):
        found |= rows(store.accept(df.filter(F.col("batch_no") == n)), "first_no", "dup_no")
    assert found == {(1, 3), (1, 4), (5, 6), (9, 10)}


def test_store_is_opened_again(spark, tmp_path):
    df = spark.createDataFrame(_records(), "record_no long, batch_no int, extension string, content string")
    _fresh(spark, tmp_path).append(df.filter("batch_no < 2"))
    (tmp_path / "store" / "texts" / "part=1").mkdir()  # an append that broke off
    assert rows(_fresh(spark, tmp_path).match(df.filter("batch_no = 3")), "first_no", "dup_no") == set()
    _fresh(spark, tmp_path).append(df.filter("batch_no = 2"))
    again = _fresh(spark, tmp_path)
    assert again.parts() == [0, 2]
    assert rows(again.match(df.filter("batch_no = 3")), "first_no", "dup_no") == {(9, 10)}
    assert rows(again.read("texts", again.parts()), "record_no") == rows(df.filter("batch_no < 3"), "record_no")


def test_a_batch_reads_only_its_cells_of_the_history(spark, tmp_path):
    df = spark.createDataFrame(_records(), "record_no long, batch_no int, extension string, content string")
    store = _fresh(spark, tmp_path)
    store.append(df)
    plan = store.read("texts", store.parts(), spark.createDataFrame([(4,)], "record_no long"), size=1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters", 1)[1].split("]")[0]
    # records equal in their set of runs, or copies, keep one entry
    assert store.read("entries", store.parts()).select("record_no").distinct().count() == 6
    assert store.read("firsts", store.parts()).filter("h2 <> 0").count() == 6


def test_overfull_blocks_are_searched_to_the_end(spark, tmp_path):
    """300 texts that share too little to be near, and late pairs behind them in the same blocks."""
    common = [f"w{i}" for i in range(60)]
    text = lambda i: " ".join(common + [f"v{i}x{j}" for j in range(14)])
    data = [(i, "txt", text(i)) for i in range(300)] + [(300 + k, "txt", text(200 + k) + " more") for k in range(5)]
    df = spark.createDataFrame(data, "record_no long, extension string, content string")
    store = _fresh(spark, tmp_path)
    store.append(df.filter("record_no < 290"))
    assert rows(store.accept(df.filter("record_no >= 290")), "first_no", "dup_no") == {(200 + k, 300 + k) for k in range(5)}


# 3: personal information


@pytest.fixture(scope="module")
def half():
    """A field trained without the sentences and names that ``compose(..., held_out=True)`` uses."""
    return pii.Field().train(pii_examples.compose(4000, 11, False), frozenset(pii_examples.ordinary_words()))


def test_items_on_held_out_sentences(half):
    right = wrong = missed = 0
    field = pii.Field(half.weights, frozenset(pii_examples.ordinary_words()))
    for text, gold in pii_examples.compose(600, 77, True):
        got, gold = set(field.best(text)), set(gold)
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.82 and right / (right + missed) > 0.82


def test_halves_share_nothing():
    one, two = ({t for t, _ in pii_examples.compose(300, 1, held)} for held in (False, True))
    assert not one & two
    made = [pii_examples._Maker(0, held) for held in (False, True)]
    first, second = ({m.of(pii_examples.GIVEN_NAMES) for _ in range(2000)} for m in made)
    assert not first & second


def test_items_in_rows(spark):
    text = "You can reach Magdalena Grivosk at (303) 555-0177.\nOur house is at 12 Mill Lane, Orton 99123. Mail: ann(at)site.example"
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, " ", "d"), (5, "x " * 20000, "e"), (6, "No item here, only 12 eggs.", "f")], "message_no long, content string, kind string")
    got = rows(pii.find_items(df, "message_no"), "row_no", "kind", "start_pos", "end_pos")
    at = lambda kind, part: (1, kind, text.index(part), text.index(part) + len(part))
    assert {g for g in got if g[1] != "NAME"} == {at("PHONE", "(303) 555-0177"), at("ADDRESS", "12 Mill Lane, Orton 99123"), at("EMAIL", "ann(at)site.example")}
    assert (1, "NAME", 14, 31) in got
    clean = {r.row_no: r.redacted for r in pii.redact(df, "message_no").collect()}
    assert clean[1].startswith("You can reach [NAME] at [PHONE].\n") and clean[2] is None and clean[3] == "" and len(clean[5]) == 40000
    assert clean[1].endswith("Mail: [EMAIL]")
    assert pii.find_items(df.filter("false"), "message_no").count() == 0


def test_every_part_of_a_long_run_is_a_candidate():
    text = "Call Ngozi Okafor Ltd Archive Office Monday about 12 34 56 78 90 12 34 56"
    spans = {(a, b) for a, b, k in pii._Text(text, frozenset()).candidates() if k == "NAME"}
    assert {(5, 17), (0, 17), (5, 10), (11, 17)} <= spans
    numbers = [b - a for a, b, k in pii._Text(text, frozenset()).candidates() if k == "PHONE"]
    assert max(numbers) == len("12 34 56 78 90 12 34 56")
    assert any(k == "EMAIL" for _, _, k in pii._Text("Ann At site.example", frozenset()).candidates())


def test_usual_words(spark):
    texts = ["Yesterday it rained. The road was wet."] * 5 + ["We met Orla yesterday. Orla left."] * 5
    found = pii.usual_of(spark.createDataFrame([(t,) for t in texts], "content string"))
    assert {"yesterday", "road", "the", "we"} <= found and "orla" not in found


def test_dynamic_programme_equals_enumeration(half):
    field = pii.Field(half.weights)
    for text, _ in pii_examples.compose(60, 5):
        read = pii._Text(text, field.usual)
        groups = [g for g in pii.stretches(read.candidates()) if len(g) <= 10]
        total = sum(sum(field.weights.get(f, 0.0) for f in read.features(s)) for s in field.best(text) if any(s in g for g in groups))
        best = 0.0
        for g in groups:
            scores = field.scores(read, g)
            best += max(
                sum(s for s, on in zip(scores, pick) if on)
                for pick in itertools.product((0, 1), repeat=len(g))
                if all(not (pick[i] and pick[j]) or g[i][1] <= g[j][0] or g[j][1] <= g[i][0] for i in range(len(g)) for j in range(i))
            )
        assert total == pytest.approx(best)


# 4: names


_NAMED = "id string, name string, kind string, place string, description string"


def _others():
    """Enough other firms and people for the table to show which words are common."""
    kinds = ["Institute", "Software", "Archive", "Telegraph"]
    roots = ["Velmot", "Karnuth", "Osperd", "Jundal", "Wexhim", "Tabrok", "Hulvane", "Pristow", "Corbeld", "Nethaz"]
    return [(f"z{i}{j}", f"{r} {k}", "organization", f"Place{i}", None) for i, r in enumerate(roots) for j, k in enumerate(kinds)]


def test_names_of_one_entity(spark):
    data = [
        ("a1", "Richard S. Dalliskberg", "person", "Kurtville", None),
        ("a2", "DALLISKBERG Richard", "person", "Kurtville", None),
        ("a3", "Dalliskberg, Rick", "person", "Kurtville", None),
        ("a4", "R. Dalliskbreg", "person", "Kurtville", None),
        ("a5", "Richard Dalliskberg", "person", None, None),
        ("a6", "Richard Dalliskberg", "person", None, "A painter whom Kurtville remembers"),
        ("a7", "Richard Dalliskberg (Kurtville)", "person", None, None),
        ("b1", "Richard Dalliskborne", "person", "Elsewhere", None),
        ("c1", "Drazust Institute S.A.", "organization", "Norby", None),
        ("c2", "Institute of Drazust", "organization", "Norby", None),
        ("c3", "drazust_institute_sa", "organization", "Norby", None),
        ("c4", "The Drazust Inst.", "organization", "Norby", None),
        ("c5", "Drazust Institute", "organization", "Southby", None),
        ("d1", "", "person", None, None),
        (None, "Nobody", "person", None, None),
        ("e1", None, "person", "Norby", "not a name"),
    ]
    df = spark.createDataFrame(data + _others(), _NAMED).withColumn("root", F.lit("clash")).withColumn("n", F.lit(1))
    got = rows(name_variants.same_name_pairs(df), "id_a", "id_b")
    expected = set(itertools.combinations(["a1", "a2", "a3", "a4", "a5", "a6", "a7"], 2)) | set(itertools.combinations(["c1", "c2", "c3", "c4"], 2))
    assert got == expected
    assert name_variants.same_name_pairs(df.filter("false")).count() == 0


def test_names_without_a_root_link_to_their_equals(spark):
    data = [
        ("a1", "J. Lee", "person", "Norby"), ("a2", "Lee, J.", "person", "Norby"), ("a3", "K. Lee", "person", "Norby"), ("a4", "J. Lee", "person", "Southby"),
        ("b1", "Robert K.", "person", "Norby"), ("b2", "Bob K", "person", "Norby"), ("b3", "Robert K.", "person", None),
        ("c1", "IBM", "organization", "Norby"), ("c2", "I.B.M.", "organization", "Norby"), ("c3", "IBN", "organization", "Norby"), ("c4", "Drazust Institute", "organization", "Norby"),
        ("d1", "NI", "organization", "Westby"), ("d2", "NI", "organization", "Westby"), ("d3", "Norvask Institute", "organization", "Westby"), ("d4", "Nulbrand Institute", "organization", "Westby"),
    ]
    df = spark.createDataFrame([(*r, None) for r in data] + _others(), _NAMED)
    assert rows(name_variants.same_name_pairs(df), "id_a", "id_b") == {("a1", "a2"), ("b1", "b2"), ("b1", "b3"), ("b2", "b3"), ("c1", "c2")}


def test_a_chain_of_spellings_leads_to_one_centre(spark):
    """Each spelling is near the next only; the first is four steps from the last."""
    chain = ["kolvemaht", "kolvemahtx", "kolvemahtxyz", "kolvemahtxyzuv", "kolvemahtxyzuvrs"]
    roots = spark.createDataFrame([("person", "p", w, 10 - i) for i, w in enumerate(chain)], "kind string, place string, root string, n long")
    assert rows(name_variants._centres(roots, ["kind", "place"]), "centre") == {(chain[0],)}


def test_delete_keys_are_never_broadcast(spark, monkeypatch):
    """The optimizer estimates exploded keys by the words' file, so a plain join would send them to the driver."""
    roots = spark.createDataFrame([("person", "p", f"kolvemaht{i}", i) for i in range(50)], "kind string, place string, root string, n long")
    plans, kept = [], name_variants.materialize
    roots = kept(roots, "roots")
    monkeypatch.setattr(name_variants, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    name_variants._centres(roots, ["kind", "place"])
    by_key = re.findall(r"(\w+Join) \[kind#\d+, place#\d+, d#\d+", plans[0])
    assert by_key and set(by_key) == {"SortMergeJoin"}


def test_tables_that_are_done_with_are_removed(spark, monkeypatch):
    """Of what is stored on the way only the tables that the result reads stay."""
    paths, kept = [], name_variants.materialize

    def stored(df, name):
        out = kept(df, name)
        paths.append((name, out.inputFiles()[:1]))
        return out

    monkeypatch.setattr(name_variants, "materialize", stored)
    found = name_variants.same_names(spark.createDataFrame(_others(), _NAMED))
    exist = {name for name, files in paths for f in files if os.path.exists(f.removeprefix("file://"))}
    assert {"names", "where"} <= exist and not exist & {"read", "forms", "spellings", "parts", "free", "rest"}
    assert found.count() == len(_others())


def test_assignment_is_optimal_at_every_length():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 7))
        gain = rng.integers(0, 10, (n, m)) / 10
        best = max(sum(gain[i, j] for i, j in enumerate(order)) for order in itertools.permutations(range(m), n))
        assert name_variants.assignment(gain.tolist()) == pytest.approx(best)
    long = [f"word{i}" for i in range(12)]
    assert name_variants.align(long, long[::-1]) == 12


@pytest.mark.parametrize("a, b, d", [("kitten", "kitten", 0), ("abcd", "abdc", 1), ("abc", "abcd", 1), ("abcdef", "badcfe", 3), ("a", "xyz", 3)])
def test_distance(a, b, d):
    assert name_variants.distance(a, b, 3) == d


# 5: formats


def test_copies_and_their_counts(spark):
    data = [
        (1, "Hello,  World", "txt"),
        (2, "hello world!", "txt"),
        (3, "HELLO-WORLD", "csv"),
        (4, "?!", "txt"),
        (5, None, "txt"),
        (6, '{"a": "X y", "b": 3}', "json"),
        (7, '{"b":"3","a":"x-Y"}', "json"),
        (8, "a: X y; b: 3", "csv"),
        (9, "b:3,a:xy", "csv"),
        (10, "lonely", None),
        (11, "", "txt"),
    ]
    df = spark.createDataFrame(data, "record_no long, content string, extension string").withColumn("copies", F.lit("clash"))
    keys = format_dups.copy_keys(df, "content", "extension").select("record_no", "k1", "k2")
    got = rows(format_dups.group_copies(keys, [], "record_no"), "keep_no", "copy_no", "copies")
    assert got == {(1, 1, 2), (1, 2, 2), (3, 3, 1), (6, 6, 2), (6, 7, 2), (8, 8, 2), (8, 9, 2), (10, 10, 1)}
    assert format_dups.group_copies(keys.filter("false"), [], "record_no").count() == 0


def test_ranges_of_the_filter_change_nothing(spark):
    df = spark.range(60_000).select(F.col("id").alias("no"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("long"))).alias("content"))
    keys = format_dups.copy_keys(df.repartition(8)).select("no", "k1", "k2")
    one, three = (rows(format_dups.group_copies(keys, [], "no", bits), "keep_no", "copy_no", "copies") for bits in (format_dups.FILTER_BITS, 1 << 19))
    assert one == three and len(one) == 60_000


def test_a_third_of_all_rows_are_copies(spark):
    df = spark.range(9000).select(F.col("id").alias("no"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("content"))
    keys = format_dups.copy_keys(df.repartition(8)).select("no", "k1", "k2")
    got = format_dups.group_copies(keys, [], "no")
    assert got.count() == 9000 and rows(got.groupBy("keep_no").count().filter("count > 1"), "keep_no", "count") == {(0, 3000)}


# 6: packing


def test_windows_hold_every_piece_once(spark):
    texts = [None, "", " "] + ["word " * n for n in (1, 3, 5, 9, 40, 41, 120, 7, 7, 7, 2)] * 3
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, window_no int")
    try:
        packed = packing.pack(df, capacity=40, buckets=4)
        sizes = {r.doc_id: r.n_tokens for r in packing.token_sizes(df).collect()}
    except ImportError:
        pytest.skip("no tokenizer files")
    out = packed.collect()
    assert {i: sum(r.n_tokens for r in out if r.doc_id == i) for i in range(len(texts))} == sizes
    used = {}
    for r in out:
        used[r.window_no] = used.get(r.window_no, 0) + r.n_tokens
        assert r.n_tokens == 40 or r.token_start + r.n_tokens == sizes[r.doc_id]
    assert max(used.values()) <= 40
    assert packing.pack(df.filter("false"), capacity=40).count() == 0


def test_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(5):
        sizes = np.sort(rng.choice(30, 9, replace=False) + 1)
        counts = rng.integers(1, 20, 9)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))  # noqa: B023, E731
        best = min(cost([*inner, sizes[-1]]) for k in range(3) for inner in itertools.combinations(sizes[:-1], k))
        assert cost(packing.bucket_bounds(sizes, counts, 3)) == best


def test_a_large_capacity_is_planned_quickly():
    sizes = np.arange(1, 32_769)
    bounds = packing.bucket_bounds(sizes, np.ones(32_768, np.int64), 64)
    assert bounds.tolist() == list(range(512, 32_769, 512))


# 7: leakage


def _edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i, *itertools.accumulate(range(len(text)), lambda left, j, r=row, p=p: min(left + 1, r[j + 1] + 1, r[j] + (p != text[j])), initial=i)][1:]
        if len(row) == len(text):
            row = [i, *row]
    return min(row)


def test_myers_equals_the_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pattern, text = rng.integers(0, 4, rng.integers(1, 14)).tolist(), rng.integers(0, 4, rng.integers(0, 20)).tolist()
        masks = {}
        for i, p in enumerate(pattern):
            masks[p] = masks.get(p, 0) | 1 << i
        table = [[0] * (len(text) + 1)]
        for i, p in enumerate(pattern, 1):
            line = [i]
            for j, t in enumerate(text, 1):
                line.append(min(line[-1] + 1, table[-1][j] + 1, table[-1][j - 1] + (p != t)))
            table.append(line)
        assert leakage.myers(masks, len(pattern), text) == min(table[-1])


def test_leaks_whole_and_in_part(spark):
    item = "list every year in which the old mill lent its long brass rain gauge to the museum"
    docs = [
        (1, "Before. " + item.upper() + "! After", "x"),
        (2, "words from year in which the old mill lent its long brass rain gauge to nobody", "x"),
        (3, "year in which the old mill lent its long wooden rain gauge to the", "x"),
        (4, "year in which the old mill", "x"),
        (5, None, "x"),
        (6, "", "x"),
        (7, "so: short item here. yes", "x"),
        (8, "ﬁne short item there", "x"),
        (9, "and eleven words only make up this little TEST item here today", "x"),
        (10, "eleven words only make up this little test thing here today", "x"),
    ]
    items = [(10, item), (11, "Short item here"), (12, None), (14, ""), (10, item), (13, "eleven words only make up this little test thing here today")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string, edits string"), spark.createDataFrame(items, "item_id long, text string")
    got = rows(leakage.leaks(d, t), "doc_id", "item_id", "edits")
    assert {g for g in got if g[2] == 0} == {(1, 10, 0), (2, 10, 0), (7, 11, 0), (10, 13, 0)}
    assert (3, 10, 1) in got and not any(g[0] == 4 for g in got)
    assert {(9, 13, 1), (10, 13, 0)} == {g for g in got if g[1] == 13}
    assert leakage.leaks(d.filter("false"), t).count() == 0 and leakage.leaks(d, t.filter("false")).count() == 0


# 8: shared spans


def test_shared_spans_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    passage, other = make(80), make(50)
    docs = [
        make(30) + passage + make(40),
        passage[:60] + make(10) + other + make(3),
        make(5) + other,
        make(100),
        passage[:49] + make(20),
        ["same"] * 130,
        make(2) + ["same"] * 60,
        make(60),
    ]
    texts = [" ".join(d) for d in docs]
    data = [(i, t.replace(" ", "\n", 3), "x") for i, t in enumerate(texts)] + [(50, texts[7].replace(" ", "\n", 3), "copy"), (60, None, ""), (61, "", ""), (62, " \t", "")]
    df = spark.createDataFrame(data, "doc_id long, text string, n_words string")
    got = rows(shared_spans.shared_spans(df), "doc_id", "word_start", "word_end")
    where = {}
    split = {i: re.findall(r"[^ \t\r\n]+", t or "") for i, t, _ in data}
    for i, w in split.items():
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s : s + 50]), set()).add(i)
    expected = set()
    for i, w in split.items():
        covered = sorted({p for s in range(len(w) - 49) if len(where[tuple(w[s : s + 50])]) > 1 for p in range(s, s + 50)})
        for _, run in itertools.groupby(enumerate(covered), lambda x: x[1] - x[0]):
            run = [p for _, p in run]
            expected.add((i, run[0], run[-1] + 1))
    assert got == expected and len(got) > 5
    assert shared_spans.shared_spans(df.filter("false")).count() == 0
