import base64
import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.llm import bpe, cutoffs, entities, mixing, mojibake, names, skeletons, spellings, survivors

FIELDS = {"doi": spellings.canonical_doi, "url": spellings.canonical_url}


# spellings


def _sources(spark, rows):
    return spark.createDataFrame(rows, "rec_id bigint, doi string, url string, key string, n bigint, f int")


def test_copies_are_found_whatever_the_writing(spark):
    rows = [
        (5, "10.1/AB-1", "https://h.example/a?x=1&y=2", "a", 1, 1), (1, " doi:10.1/ab–1. ", "<HTTPS://H.EXAMPLE/a?y=2&x=1>", "b", 2, 2), (9, "https://doi.example/doi.example/10.1/ab-1/", "https://h.example/a?x=1&y=2;", "c", 3, 3),
        (2, "10.1/a-b1", "https://h.example/a?x=1&y=2", None, None, None), (3, None, "https://h.example/b/", "", 0, 0), (4, "", "https://h.example/b#", "", 0, 0), (6, " ", " ", "", 0, 0), (7, None, None, "", 0, 0), (8, "10.1/ab-1", None, "", 0, 0),
    ]
    got = sorted(tuple(r) for r in spellings.copies(_sources(spark, rows), "rec_id", FIELDS).collect())
    assert got == [(1, 5), (1, 9), (3, 4)]
    assert sorted(tuple(r) for r in spellings.collapse(_sources(spark, rows), "rec_id", FIELDS).collect()) == [(1, 3), (2, 1), (3, 2), (8, 1)]


def test_spellings_of_empty_and_very_long_values(spark):
    assert spellings.copies(_sources(spark, []), "rec_id", FIELDS).count() == 0
    long = "10.1/" + "a1" * 50_000
    got = spellings.copies(_sources(spark, [(1, long, None, "", 0, 0), (2, long.upper(), "", "", 0, 0), (2, long.upper(), "", "", 0, 0)]), "rec_id", FIELDS)
    assert [tuple(r) for r in got.collect()] == [(1, 2)]


# skeletons


def test_skeletons_join_what_looks_the_same_and_nothing_else():
    s = skeletons.skeleton
    assert s("ｆull　width") == s("full width") == s("fu​ll width") == s("ﬁ".replace("ﬁ", "f") + "ull width")
    assert s("café") == s("café") != s("cafe") and s("раper") == s("paper") and s("ﬂow") == s("flow") and s("5 Ω") == s("5 Ω") and s("µm") == s("μm")
    for a, b in (("m²", "m2"), ("Abc", "abc"), ("α", "alpha"), ("a.", "a"), ("l", "1"), ("é", "è")):
        assert s(a) != s(b)


@given(st.text(alphabet="aе é́ｂ​Ω²", max_size=12))
@settings(max_examples=200, deadline=None)
def test_skeletons_are_stable(text):
    s = skeletons.skeleton(text)
    assert skeletons.skeleton(s) == s and skeletons.skeleton(unicodedata.normalize("NFC", text)) == s == skeletons.skeleton(skeletons.normal_form(text))


def test_pairs_of_skeletons_against_brute_force(spark):
    rnd = random.Random(3)
    texts = ["drift", "dri​ft", "ｄrift", "drіft", "other", "", None, " ", "​", "οther", "x" * 100_000, "x" * 99_999 + "ｘ"]
    rows = [(i, rnd.choice(texts), "z") for i in range(80)]
    df = spark.createDataFrame(rows, "item_id bigint, claim string, field string")
    got = sorted((r.first_id, r.second_id) for r in skeletons.pairs(skeletons.prints(df, "item_id", ["claim"])).collect())
    want = sorted((i, j) for i, a, _ in rows for j, b, _ in rows if i < j and a and b and a != b and skeletons.skeleton(a) == skeletons.skeleton(b) and skeletons.skeleton(a).strip())
    assert got == want and len(want) > 50
    assert skeletons.pairs(skeletons.prints(df.where("false"), "item_id", ["claim"])).count() == 0
    forms = {r.rid: r.form for r in skeletons.normalised(df, "item_id", ["claim"]).collect()}
    assert forms[next(i for i, t, _ in rows if t is None)] is None and forms[next(i for i, t, _ in rows if t == "drіft")] == "drift"


# cut-off texts


def test_ends_of_texts(spark):
    rows = [
        (1, "The drift was measured and it lowered the err", True), (2, "The drift was measured.", False), (3, "The drift was …", True), (4, "We saw this, e.g.", True), (5, "It fell. Keywords: drift; error", False),
        (6, "It fell. Trial registration LX-12345", False), (7, "See https://a.example/x", False), (8, "It fell. (All sites pooled, n = 5)", False), (9, "“It fell.”", False), (10, "It fell. Earlier work attributed (", True),
        (11, None, None), (12, "   ", None), (13, "Dr", True), (14, "It fell. \n", False), (15, "x" * 200_000, True), (16, "It fell?", False), (17, "Ｉｔ ｆｅｌｌ．", False), (18, "It fell [...]", True), (19, "Ends in мid�", True),
    ]
    df = spark.createDataFrame([("t", i, None if i % 2 else "s", t) for i, t, _ in rows], "part string, rid bigint, source string, body string")
    got = {r.rid: r.cut for r in cutoffs.verdicts(df).collect()}
    assert got == {i: c for i, _, c in rows if c is not None}
    shares = {r.source: (r.texts, r.cut) for r in cutoffs.shares(cutoffs.verdicts(df)).collect()}
    assert sum(n for n, _ in shares.values()) == 17 and set(shares) == {None, "s"}
    assert cutoffs.verdicts(df.where("false")).count() == 0


def test_an_unmarked_ending_that_many_texts_share_is_no_cut(spark):
    df = spark.createDataFrame([("t", i, "s", f"Text number {i} says a thing. Signed by the board") for i in range(40)] + [("t", 99, "s", "Here the board of the")], "part string, rid bigint, source string, body string")
    got = {r.rid: r.cut for r in cutoffs.verdicts(df).collect()}
    assert not any(got[i] for i in range(40)) and got[99]


def test_unmarked_endings_are_decided_by_how_often_they_go_on(spark):
    texts = [f"Text number {i} of {'abcdefghij'[i % 10] * (i // 10 + 1)} says a thing. Signed by the board" for i in range(30)]
    texts += [f"In {'abcdefghij'[i % 10] * (i // 10 + 1)} the drift was lowered by the model in spring." for i in range(3000)][:1500]
    cut = ["Word one: the drift was lowered by the model", "Word two: the drift was low", "In a case never seen the drift"] + [f"In {'klmnop'[i % 6] * (i // 6 + 1)} the drift was lowered by the mod" for i in range(25)]
    df = spark.createDataFrame([("t", i, "s", x) for i, x in enumerate(texts + cut)] + [("t", 9000 + i, "s", cut[0]) for i in range(3000)], "part string, rid bigint, source string, body string")
    got = {r.rid: r for r in cutoffs.verdicts(df).collect()}
    assert len(got) == len(texts) + len(cut) + 3000 and not any(got[i].cut for i in range(len(texts)))
    assert all(got[i].cut for i in got if i >= len(texts))
    assert got[0].inside == 0 and got[0].ends == 30 and got[9000].ends == 1 and got[9000].inside == 1500
    assert all(r.inside > 0 for i, r in got.items() if i >= len(texts))
    broken = spark.createDataFrame([("t", i, "s", f"In {'abcdefghij'[i % 10] * (i // 10 + 1)} n &lt") for i in range(40)], "part string, rid bigint, source string, body string")
    assert all(r.cut for r in cutoffs.verdicts(broken).collect())


# tokenizer


@pytest.fixture(scope="module")
def reference_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    t = bpe.load()
    spec = Path(bpe.TOKENIZERS) / "byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in spec.read_bytes().splitlines())}
    import importlib.util
    s = importlib.util.spec_from_file_location("pt", Path(bpe.TOKENIZERS) / "__init__.py")
    m = importlib.util.module_from_spec(s)
    s.loader.exec_module(m)
    return t, tiktoken.Encoding("own", pat_str=m.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_published_encoding(reference_tokenizer, text):
    t, ref = reference_tokenizer
    assert t.encode(text) == ref.encode_ordinary(text)


def test_ids_of_hard_texts(spark, reference_tokenizer):
    t, ref = reference_tokenizer
    hard = ["<|endoftext|>", "a" * 20_000, "ab" * 5_000 + "é", "   \n\n\t x", "日本語のテキスト", "🙂👩‍🔬", "aaaaabaaaab" * 300]
    assert all(t.encode(x) == ref.encode_ordinary(x) for x in hard)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "drift drift")], "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in rows.select("doc_id", bpe.token_ids(F.col("text")).alias("ids")).collect()}
    assert got == {1: [], 2: [], 3: ref.encode_ordinary("drift drift")}
    assert [r[0] for r in rows.orderBy("doc_id").select(bpe.token_count(F.col("text"))).collect()] == [0, 0, len(got[3])]


# mixing


def test_highest_quotients_against_the_plain_method():
    rnd = random.Random(1)
    for _ in range(50):
        w = [rnd.choice([0, rnd.random()]) for _ in range(rnd.randint(1, 8))]
        seats = rnd.randint(0, 60)
        got = [0] * len(w)
        for _ in range(seats if sum(w) else 0):
            i = max(range(len(w)), key=lambda k: (w[k] / (2 * got[k] + 1), -k))
            got[i] += 1
        assert mixing.sainte_lague(w, seats) == got
    assert mixing.sainte_lague([1, 1], 10, [2, 9]) == [2, 8] and mixing.sainte_lague([], 5) == []


def _mix(spark, docs, targets, **k):
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mix(sizes, t, **k), t


def test_mix_reaches_its_shares_within_the_caps(spark):
    rnd = random.Random(2)
    docs = [(i, s, rnd.randint(5, 60)) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 60 + ["none"] * 50)]
    out, t = _mix(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 5), ("gone", 0.05, 2), ("zero", 0.0, 1), (None, 0.1, 1)])
    got = {r.source: r for r in mixing.report(out, t).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(got[s].actual_share - share / 0.95) < 0.01
    assert got["gone"].actual_share == 0 and got["small"].most_copies <= 5 and got["mid"].most_copies <= 2 and got["big"].most_copies == 1 and "none" not in got
    again, _ = _mix(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 5)])
    assert again.count() > 0 and sorted(map(tuple, out.collect())) == sorted(map(tuple, _mix(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 5), ("gone", 0.05, 2), ("zero", 0.0, 1), (None, 0.1, 1)])[0].collect()))


def test_empty_mixes(spark):
    assert _mix(spark, [], [("a", 1.0, 1)])[0].count() == 0 and _mix(spark, [(1, "b", 3)], [("a", 1.0, 1)])[0].count() == 0
    out, t = _mix(spark, [(1, "a", 3)], [("a", 1.0, None)])
    assert [tuple(r) for r in out.collect()] == [(1, "a", 3, 1)]


# wrong encodings


SENTENCES = ["Wir prüfen das Verfahren für Gewächshäuser am Ort Nummer {}.", "La señal mejoró según la última evaluación número {} aquí.", "Мы проверили этот способ в условиях горных станций при {} повторах.", "Nous présentons une méthode destinée à la forêt âgée {}."]


def _garble(s, written, read):
    high = mojibake._high(read)
    return "".join(high.get(b, chr(b)) for b in s.encode(written))


def test_restoring_is_a_round_trip(spark):
    docs = [(i, SENTENCES[i % 4].format(i // 4)) for i in range(240)]
    bad = {}
    for k, (w, r) in enumerate([("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1252")] * 4):
        i = 1000 + k
        src = SENTENCES[k % 4].format(k)
        bad[i] = (src, _garble(src, w, r))
    for k in range(6):
        src = SENTENCES[2].format(70 + k)
        bad[2000 + k] = (src, _garble(src, "cp1251", "cp1252"))
    double = SENTENCES[0].format(3)
    bad[3000] = (double, _garble(_garble(double, "utf-8", "cp1252"), "utf-8", "cp1252"))
    quoting = [(4000 + i, f"The file {i} quotes the string Ã¼ on purpose to show it.") for i in range(12)]
    rows = docs + [(i, g) for i, (_, g) in bad.items()] + quoting + [(5000, None), (5001, ""), (5002, "plain ascii"), (5003, "lost ch�racter")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in mojibake.restored(df).collect()}
    assert set(got) == set(bad) | {5003}
    right = sum(got[i] == src for i, (src, _) in bad.items())
    assert right >= len(bad) - 2
    assert mojibake.restored(df.where("false")).count() == 0


def test_a_garbled_text_with_a_third_of_the_rows_is_found(spark):
    docs = [(i, SENTENCES[i % 4].format(i // 4)) for i in range(240)] + [(1000 + k, _garble(SENTENCES[2].format(70 + k), "cp1251", "cp1252")) for k in range(6)]
    docs += [(2000 + k, _garble(SENTENCES[k % 4].format(k), "utf-8", "cp1252")) for k in range(8)]
    docs += [(3000 + k, docs[240][1]) for k in range(130)]
    got = {r.doc_id: r.restored for r in mojibake.restored(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert set(got) == {i for i, _ in docs if i >= 1000} and got[3000] == SENTENCES[2].format(70)


def test_alignment():
    assert mojibake.aligned("für é", "fÃ¼r Ã©") == [("ü", "Ã¼"), ("é", "Ã©")] and mojibake.aligned("für", "fxr") == []
    assert ("utf-8", "cp1252") in mojibake.explained("ü", "Ã¼") and mojibake.back("Ã¼", "utf-8", "cp1252") == "ü"


# survivors


def test_branch_and_bound_against_all_combinations():
    import itertools
    rnd = random.Random(5)
    for _ in range(60):
        b = [[(rnd.random(), rnd.choice("abc")) for _ in range(rnd.randint(0, 5))] for _ in range(3)]
        ok = {(k, s): rnd.random() < 0.7 for k in range(3) for s in "abc"}
        value = lambda pick: sum(b[k][i][0] for k, i in enumerate(pick) if i is not None)
        options = [[None, *(i for i, (_, s) in enumerate(x) if ok[k, s])] for k, x in enumerate(b)]
        assert value(survivors.choose(b, lambda k, s: ok[k, s])) == pytest.approx(max(map(value, itertools.product(*options))))


def test_survivors(spark):
    rows = [
        (1, "g", "Letters in Polar Logistics", "Whole text with 12 plots. It ends here.", ["Ann Lee", "Bo Ray"], "2024-01-01", "k"), (2, "g", "Lett. Polar Logist.", "Skip to main content. Whole text with 12 plots. It ends here.", ["A. Lee", "B. Ray"], "2025-01-01", "k"),
        (3, "g", "Letters in Polar Logistics", "Whole text with 12 plots. It", ["Ann Lee", "et al."], "2024-05-01", "k"), (4, "g", "See the publisher's site for full venue information", "Whole text with 9 plots. It ends here.", [], "2024-03-01", "k"), (5, "g", None, None, None, None, "k"),
        (6, "h", "X", "Y.", ["Z"], "2024-01-01", "k"), (7, None, "X", "Y.", ["Z"], "2024-01-01", "k"), (8, "i", None, "", [], "2024-01-01", "k"), (9, "i", "N/A", "n/a", ["et al."], "2024-01-01", "k"),
    ]
    df = spark.createDataFrame(rows, "cand_id bigint, canonical_id string, venue string, content string, authors array<string>, at string, key string").withColumn("at", F.col("at").cast("timestamp"))
    bundles = (survivors.venue(), survivors.content(), survivors.authors())
    got = {r.canonical_id: (r.venue_id, r.content_id, r.authors_id) for r in survivors.survivors(df, "canonical_id", "cand_id", "at", bundles).collect()}
    assert got == {"g": (3, 4, 1), "i": (None, None, None)}
    assert survivors.survivors(df.where("false"), "canonical_id", "cand_id", "at", bundles).count() == 0
    rec = survivors.records(df, "canonical_id", "cand_id", "at", bundles).where("canonical_id = 'g'").first()
    assert rec.venue == "Letters in Polar Logistics" and rec.authors == ["Ann Lee", "Bo Ray"]


# names


PERSONS = [(1, "Robert G. Stroraberg"), (2, "Rosalía Stroraberg"), (3, "Elizabeth van Melman"), (4, "Christopher K. Prugulund"), (5, "Frederick Dravsoash-Norkaash")]
JOURNALS = [(1, "Letters in Computational Drone Navigation"), (2, "Proceedings of the Society for Applied Moss Ecology"), (3, "Letters in Comparative Drone Navigation"), (4, "The Bulletin of Applied Claims and Reasoning")]
MEANT = {
    ("author", "Stroraberg, Robert G."): 1, ("author", "DR. R. G. STRORABERG"): 1, ("author", "Bob Strroaberg, PhD"): 1, ("author", "Ros. Stroraberg*"): 2, ("author", "van Melman, Beth"): 3, ("author", "E. van Melman (corresponding author)"): 3,
    ("author", "Prugulund KitK"): 4, ("author", "Dravsoash-Norkaash Fred"): 5, ("author", "Rebecca Stroraberg"): None, ("author", "Robert K. Stroraberg"): None, ("author", "Robert G. Stroraberg"): 1, ("author", "Robert Quilnov"): None, ("author", "et al."): None,
    ("journal", "Lett. Comput. Drone Navig."): 1, ("journal", "LCDN"): None, ("journal", "Applied Moss Ecology, Proceedings of"): 2, ("journal", "Lett. Comp. Drone Navig."): 3, ("journal", "Bulletin of Applied Claims and Raesoning"): 4,
    ("journal", "Letters in Computational Drone Navigation, Series B"): None, ("journal", "BACR"): 4, ("journal", "Annals of Kiln Physics"): None, ("journal", "Letters in Computational Drone Navigation (Online)"): 1, ("journal", "x" * 20_000): None,
}


def _reference(spark):
    return spark.createDataFrame([("author", i, n) for i, n in PERSONS] + [("journal", i, n) for i, n in JOURNALS] + [("author", 9, None)], "kind string, entity_id bigint, name string")


def test_spellings_mean_the_right_entity(spark):
    said = spark.createDataFrame([(k, i, 1, s) for i, (k, s) in enumerate(MEANT)] * 2, "kind string, row_id bigint, slot bigint, spelling string")
    got = defaultdict(list)
    keys = list(MEANT)
    for r in names.link(said, _reference(spark)).collect():
        got[keys[r.row_id]].append((r.entity_id, r.exact))
    assert {k: v[0][0] for k, v in got.items()} == {k: v for k, v in MEANT.items() if v} and all(len(v) == 2 for v in got.values())
    assert got["author", "Robert G. Stroraberg"][0][1] and not got["author", "Bob Strroaberg, PhD"][0][1]
    assert names.link(said, _reference(spark).where("false")).count() == 0 and names.link(said.where("false"), _reference(spark)).count() == 0


def test_the_join_over_grams_gives_the_same(spark, monkeypatch):
    s = spark.createDataFrame([k for k in MEANT if len(k[1]) < 1000], "kind string, spelling string")
    a = sorted(map(tuple, names.link_spellings(s, _reference(spark)).collect()))
    monkeypatch.setattr(names, "REFERENCE_ROWS", 0)
    assert sorted(map(tuple, names.link_spellings(s, _reference(spark)).collect())) == a and len(a) > 10


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_edit_distance(a, b, most):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert names.distance(a, b, most) == min(d[len(a), len(b)], most + 1)


# entities


def test_matching_without_keys(spark):
    rnd = random.Random(7)
    syl = ["ka", "ro", "mi", "te", "zu", "vo", "la", "ne", "pi", "su"]
    name = lambda: "".join(rnd.choice(syl) for _ in range(5))
    people = [f"Given{c} Sur{name()}" for c in "abcdefghijkl" for _ in range(3)]
    a, b, want = [], [], set()
    for i in range(150):
        t, who, y, doi = f"{name()}: a drift monitor for early detection in {rnd.choice(['fleets', 'soils'])}", rnd.sample(people, rnd.randint(1, 3)), rnd.randint(1995, 2024), f"10.1/{i}-{rnd.randint(1, 999)}"
        a.append((i, t, who, y, doi if i % 3 else None, "x"))
        if i % 2 == 0:
            k = rnd.randint(0, len(t) - 30)
            b.append((1000 + i, (t[:k + 20] + t[k + 21:]) if i % 4 else t.upper(), [w.split()[1] + ", " + w[0] + "." for w in who], y + (i % 8 == 0), doi if i % 6 == 0 else None, "x"))
            want.add((i, 1000 + i))
        elif i % 5 == 0:
            b.append((1000 + i, "Erratum: " + t, who, y, None, "x"))
    b += [(2000 + i, "Editorial", [people[i]], 2000, None, "x") for i in range(10)] + [(3000, None, None, None, None, "x"), (3001, "", [], None, "", "x")]
    a += [(2000, "Editorial", [people[20]], 2010, None, "x"), (3000, None, None, None, None, "x")]
    cols = "title string, authors array<string>, year int, doi string, p1 string"
    left, right = spark.createDataFrame(a + a[:2], "rec_id bigint, " + cols), spark.createDataFrame(b, "work_id bigint, " + cols)
    rows = entities.matches(left, "rec_id", right, "work_id").collect()
    got = {(r.rec_id, r.work_id) for r in rows}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.03 * len(want) and all(0.5 <= r.confidence <= 1 for r in rows)
    assert entities.matches(left.where("false"), "rec_id", right, "work_id").count() == 0


def test_mixture_separates_two_clouds():
    rnd = random.Random(1)
    c = Counter()
    for _ in range(900):
        c[rnd.choice([3, 5, 8]), rnd.choice([0, 1, 2]), rnd.choice([2, 3, 3]), rnd.choice([2, -1])] += 1
    for _ in range(100):
        c[0, 10, rnd.choice([0, 0, 1, -1]), rnd.choice([0, -1])] += 1
    cells, n = np.array(list(c)), np.array(list(c.values()))
    m = entities.Mixture(cells, n)
    q = m.run()
    assert all((p > 0.5) == (k[0] == 0) for k, p in zip(cells, q)) and abs(m.pi - 0.1) < 0.03


def test_title_words():
    u = entities.unmatched
    assert u("drift monitor for soils here", "drift mointor for soils here") == 0 and u("erratum drift monitor soils here", "drift monitor soils here") == 1 and u("", "x") is None
    assert u("editorial", "editorial") == entities.SHORT and u("drift monitor for soils fleets study of cores", "drift monitor soils fleets") == entities.HEAD
    assert not re.search(" ", "") and u("open access drift monitor", "openaccess drift monitor") == 0
