import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pathloom.llm import forum, leakage, lookalike, packing, residue, terms

from ..data import ENTRIES, HITS

DOCS = "doc_id LONG, text STRING, source STRING"


def hits(spark, rows):
    return spark.createDataFrame([(i, 1, n, p, False, None, None, None) for i, n, p in rows], HITS)


def test_terms(spark):
    rnd = random.Random(1)
    words = ["a", "b", "Ä1", "x_y", "ß", "", "İ"]
    rows = [(i * 1000, " ".join(rnd.choices(words, k=rnd.randrange(0, 7))), None) for i in range(120)]
    rows += rows[:30] + [(None, "a", None), (999_999, None, None), (5_000_001, "w " * 3000, None)]
    want_n, want_d = Counter(), Counter()
    for _, name, _ in {r for r in rows if r[0] is not None and r[1] is not None}:
        found = []
        for ch in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in name.lower()).split():
            found.append(ch)
        want_n.update(found)
        want_d.update(set(found))
    df = hits(spark, rows).withColumn("term", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = {r["term"]: r for r in terms.term_statistics(df, "hit_id", "name").collect()}
    assert {k: (r["n_occurrences"], r["n_records"]) for k, r in got.items()} == {k: (want_n[k], want_d[k]) for k in want_n}
    assert got["w"]["mark"] == "rare" and got["a"]["mark"] == "common" and terms.count_records(df, "hit_id", "name") == 121
    assert terms.term_statistics(hits(spark, []), "hit_id", "name").count() == 0


def test_bitmaps_merge_by_union(spark):
    rows = [(i, ("a a b" if i % 2 else "a c c c") + f" {i % 4}", None) for i in range(40)] + [(70_000, "b b", None), (-3, "a", None)]
    whole = terms.term_bitmaps(hits(spark, rows), "hit_id", "name")
    merged = terms.merge_bitmaps(*[terms.term_bitmaps(hits(spark, part), "hit_id", "name") for part in (rows[:25], rows[15:])])
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
    words = {(r["term"], r["level"], r["block"]): r["bits"] for r in whole.collect()}
    assert words["a", 2, 0] == sum(1 << i for i in range(1, 40, 2)) and words["b", 2, 70_000 >> 6] == 1 << (70_000 & 63) and words["a", 1, -1] == 1 << 61


def test_long_texts_are_counted_like_short_ones(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices("abcde", k=rnd.randrange(1, 40))), None) for i in range(60)]
    want = sorted(map(str, terms.term_bitmaps(hits(spark, rows), "hit_id", "name").collect()))
    monkeypatch.setattr(terms, "LONG_TEXT", 20)
    assert sorted(map(str, terms.term_bitmaps(hits(spark, rows + rows[:20]), "hit_id", "name").collect())) == want


TWINS = [
    ("report.txt", "rероrt.txt"), ("report.txt", "ｒｅｐｏｒｔ.txt"), ("café", "café"), ("ﬁle", "file"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("oca", "оса"), ("ΚOSI", "KOSI"),
    ("report", "𝐫𝐞𝐩𝐨𝐫𝐭"), ("ALSO", "ꓮꓡꓢꓳ"), ("HAT", "ᎻᎪᎢ"), ("cop", "ⲥⲟⲣ"), ("naïve", "nаı̈ve".replace("ı", "i")), ("ёлка", "ëлка"), ("журнал", "журнaл"),
]
DIFFER = [("Report", "report"), ("cafe", "café"), ("x2", "x²"), ("l", "1"), ("O", "0"), ("rn", "m"), ("журнал", "журна"), ("a b", "ab")]


def test_canonical():
    reader = lookalike.Reader({("", "ж"): 5, ("ж", "у"): 5, ("а", "л"): 5, ("", "o"): 5})
    for a, b in TWINS:
        assert reader.canonical(a) == reader.canonical(b), (a, b)
    for a, b in DIFFER:
        assert reader.canonical(a) != reader.canonical(b), (a, b)
    assert reader.canonical("журнaл") == "журнал" and reader.canonical("rероrt") == "report"
    for text in ("", "plain ASCII.txt", "資料", "e" * 70_000, "́"):
        assert reader.canonical(reader.canonical(text)) == reader.canonical(text)


def test_a_kept_model_gives_the_same_forms(spark, tmp_path):
    first = hits(spark, [(1, "журнал", "p"), (2, "архив", "p"), (3, "журнaл", "p")])
    none = spark.createDataFrame([], ENTRIES)
    reader = lookalike._prepared(none, first)[1]
    lookalike.save_model(spark, reader, str(tmp_path / "model"))
    kept = lookalike.load_model(spark, str(tmp_path / "model"))
    assert kept.bigrams == reader.bigrams
    later = hits(spark, [(9, "журнaл", "p"), (10, "cop", "p")])
    assert {r["id"]: r["canonical"] for r in lookalike.canonical_names(none, later, kept).collect()} == {9: "журнал", 10: "cop"}


def test_the_model_counts_plain_names_too(spark):
    plain = ["race rank_ray2", "RACE", "", "x\ny", "naïve", "журнал", "наш сажа", "ﬁle", "Ж1ж", "мiх", "資料"]
    rows = [(i, plain[i % len(plain)], "p") for i in range(50)] + [(99, "rажer", "p"), (100, None, "p")]
    e, h = spark.createDataFrame([(i, 0, i, 1, n, 0, None) for i, n, _ in rows[::3]], ENTRIES), hits(spark, rows)
    want = Counter()
    for name in [n for _, n, _ in rows + rows[::3] if n is not None]:
        for token in lookalike._TOKEN.findall(lookalike.simplify(name)):
            letters = [ch for ch in token if not unicodedata.combining(ch)]
            if len(scripts := {lookalike.script(ch) for ch in letters}) == 1 and "other" not in scripts:
                want.update(zip(["", *letters], letters))
    reader = lookalike._prepared(e, h)[1]
    assert reader.bigrams == want and want["r", "a"] > 0 and want["", "r"] > 0
    form = {r["name"]: r["canonical"] for r in lookalike.canonical_names(e, h).collect()}["rажer"]
    odd = lookalike.train(h.where("name rlike '[^\\\\x00-\\\\x7F]'"))
    assert form == lookalike.Reader(want).canonical("rажer") != odd.canonical("rажer")


def test_twins(spark):
    names = [n for pair in TWINS + DIFFER for n in pair]
    rows = [(i, 0, i, i % 2 if i % 7 else None, names[i % len(names)] if i % 11 else None, 0, None) for i in range(200)]
    hit_rows = [(i, names[(i * 3) % len(names)], ["p", None][i % 5 == 0]) for i in range(120)] + [(3, names[9], "p")]
    e = spark.createDataFrame(rows, ENTRIES).withColumn("canonical", F.lit("clash")).withColumn("form", F.lit("clash"))
    h = hits(spark, hit_rows)
    reader = lookalike._prepared(e, h)[1]
    want, groups = set(), defaultdict(list)
    for i, v, _, p, n, _, _ in rows:
        if p is not None and n is not None:
            groups["entries", v, p, reader.canonical(n)].append((i, n))
    for i, n, p in hit_rows:
        if p is not None:
            groups["hits", p, 0, reader.canonical(n)].append((i, n))
    for (tab, *_), members in groups.items():
        want |= {(tab, min(i, j), max(i, j)) for i, a in members for j, b in members if i != j and a != b}
    got = [(r["tab"], r["id_a"], r["id_b"]) for r in lookalike.lookalike_pairs(e, h).collect()]
    assert set(got) == want and len(got) == len(want)
    assert lookalike.canonical_names(e, h).count() == sum(r[4] is not None for r in rows) + len(hit_rows)
    none = spark.createDataFrame([], ENTRIES)
    assert lookalike.lookalike_pairs(none, hits(spark, [])).count() == 0


def test_leakage(spark):
    rnd = random.Random(3)
    vocab = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    item = lambda: rnd.choices(vocab, k=30)
    items = [(i, item()) for i in range(5)]
    docs = []
    for i in range(60):
        _, words = items[i % 5]
        size = rnd.choice([5, 11, 12, 13, 30])
        at = rnd.randrange(0, len(words) - size + 1)
        part = " ".join(words[at:at + size])
        part = [part, part.upper(), part.replace(" ", " <b>", 1).replace(" ", "&nbsp;", 1), "> " + part.replace(" ", "\n> ")][i % 4]
        docs.append((i, f"{' '.join(item())}. {part}", "s"))
    docs += docs[:3] + [(900, None, "s"), (901, "", None), (None, docs[4][1], "s"), (902, "word " * 50_000, "s")]
    want = set()
    for i, text, _ in docs:
        if i is not None and text:
            words = leakage.words(text)
            windows = {tuple(words[k:k + 12]) for k in range(len(words) - 11)}
            want |= {(i, j) for j, w in items if any(tuple(w[k:k + 12]) in windows for k in range(len(w) - 11))}
    q = spark.createDataFrame([(i, " ".join(w), "en") for i, w in items] + [(77, None, None), (78, "too short", "en")], "item_id long, text string, lang string")
    d = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash"))
    got = [(r["doc_id"], r["item_id"]) for r in leakage.leaked(d.drop("item_id"), q).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert leakage.leaked(spark.createDataFrame([], DOCS), q).count() == 0
    assert leakage.leaked(d, q.where("false")).count() == 0
    assert leakage.words("a[b]<i>c</i> d&amp;e [deleted]") == ["ac", "d", "e"]


def test_shuffled_items_give_the_same(spark, monkeypatch):
    q = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)), "en")], "item_id long, text string, lang string")
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3, 18)), "s"), (2, "w1 w2", "s")], DOCS)
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    assert [tuple(r) for r in leakage.leaked(d, q).collect()] == [(1, 1)]


def test_reparameterised(spark):
    text = "Anna has {a} apples and gives {b} apples to Tom so how many of the {a} apples does she still have after {c} days"
    q = spark.createDataFrame([(1, text.format(a=12, b=5, c=3), "en")], "item_id long, text string, lang string")
    docs = [(1, text.format(a=12, b=5, c=3)), (2, text.format(a=40, b=7, c=9).replace("Anna", "Lucy")), (3, text.format(a=40, b=7, c=9).replace("the 40", "the 41")), (4, "nothing of the sort")]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS)
    assert {r["doc_id"]: r["kind"] for r in leakage.contamination(d, q).collect()} == {1: "literal", 2: "reparameterised"}


CASES = {
    "Hello {{ user.name }}, welcome": "slot", "We moved %FIRST_NAME% away": "slot", "Dear [TOPIC], see ${date}": "slot", "a &lt;reply url&gt; b": "slot", "x <%= board %> y": "slot", "(your name here)": "slot",
    "Error 404\nRequest id 1f62aa": "error", "HTTP 502: Bad Gateway<br>": "error", "> quoted words of somebody\nSorry! The board failed to load.": "error", "Ошибка 503: сервер не отвечает.": "error",
    "Traceback (most recent call last):\n  File \"/srv/a.py\", line 3, in f\nKeyError: 'x'": "error", "<noscript>Please enable JavaScript to view this post.</noscript>": "notice",
    "Bitte Skripte erlauben und neu laden. [Reload]": "notice", "JS required": "notice", "Lorem ipsum dolor sit amet magna.": "filler", "TODO: write postTODO: write post": "filler", "asdf asdf asdf": "filler",
    "SQL error [1077]: lost connection to the database server during query": "error", "Render exception 12: no such view": "error",
    "Your content goes here.\n--\nA signature of some length that is not counted": "filler",
}
NO_CASES = [
    "[deleted]", "<removed>", "", None, "My server answers with 503 Service Unavailable every night, the log says nothing.", "Who put lorem ipsum into the manual? The designer never came back to it.",
    "You have to write [code]{{ user.name }}[/code] in the template.", "> Hello {{ name }}\nWhy is that in my mail?", "[quote=x]Error 404[/quote]\nI get this all day, what can I do about it?",
    "The manual says %APPDATA% must point at the disk.", '{"a": 1, "b": [2, 3]} is what the tool writes.', "I switched JavaScript off for the page and it loads twice as fast.",
    'The message "Please enable JavaScript" came up again on my tablet.', "<blockquote>JS required</blockquote> Same here, since Monday.", "[b]bold[/b] [img]x[/img] [19:00:58] vol F usn 97",
]


def test_residue(spark):
    rows = [(i, t, "host") for i, t in enumerate(list(CASES) + NO_CASES)] + [(0, list(CASES)[0], "host"), (None, "Error 404", "host"), (500, "some words here. " * 30_000, None)]
    d = spark.createDataFrame(rows, DOCS).withColumn("lines", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {r["doc_id"]: r["kind"] for r in residue.residue(d).collect()}
    assert got == dict(enumerate(CASES.values()))
    kept = residue.clean(d)
    assert kept.columns == ["doc_id", *[c for c in d.columns if c != "doc_id"]] and kept.count() == len(NO_CASES) + 2
    assert residue.residue(spark.createDataFrame([], DOCS)).count() == 0


def test_boilerplate_is_subtracted(spark):
    footer = "You are reading the garden board of the north side, be kind to each other and enjoy."
    rows = [(i, f"Some words of post {'abcdefghijklmnopqrstuvwxyz'[i % 26]} {i}.\n{footer}", "a") for i in range(40)] + [(100, f"Error 404\n{footer}", "a"), (101, f"Error 404\n{footer}", "b")]
    assert [r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, DOCS)).collect()] == [100]


def test_unlisted_names_and_number_words(spark):
    item = "Yesterday in the market Priya bought seven red apples and gave 3 of them and Priya went home by bus"
    copy = item.replace("Priya", "Okonkwo").replace("seven", "ninety")
    mixed = item.replace("Priya", "Okonkwo", 1).replace("Priya", "Novak")
    texts = [(1, copy), (2, item.lower()), (3, mixed), (4, item.replace("Priya", "James")), (5, copy.replace("red", "old").replace("gave", "sold"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["kind"], r["n_windows"]) for r in leakage.contamination(docs, items).collect()}
    n = len(item.split()) - 11
    assert got == {1: ("reparameterised", n), 2: ("literal", n), 4: ("reparameterised", n)}
    assert [r["doc_id"] for r in leakage.leaked(docs, items).collect()] == [2]


def test_boilerplate_follows_the_size_of_the_host(spark):
    footer = "You are reading the garden board of the north side, be kind to each other and enjoy."
    said = "In my case that second garden carried the bracket over the wall and down to the boat."
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"Some words of post {word(i)}.\n{footer}", "small") for i in range(4)] + [(10, f"Error 404\n{footer}", "small")]
    rows += [(1000 + i, f"Some words of post {word(i)}.\n{said if i < 30 else ''}", "large") for i in range(1000)] + [(20, f"Error 404\n{said}", "large")]
    rows += [(3000 + i, f"Some words of post {word(i)}.", "repeats") for i in range(20)] + [(30, f"Error 404\n{said}", "repeats")] * 30
    assert [r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, DOCS)).collect()] == [10]


def test_slices(monkeypatch):
    monkeypatch.setattr(forum, "FRAME_CHARS", 5)
    texts = ["abc", None, "ab", "x", "y" * 20, "", "z"]
    cut = list(forum.slices(texts))
    assert [t for s in cut for t in texts[s]] == texts and len(cut) == 4 and list(forum.slices([])) == []


def test_own_words():
    assert forum.own_words("a\n> b\nc") == "a\nc" and forum.own_words("<blockquote>a<blockquote>b</blockquote>c</blockquote>d") == "d"
    assert forum.own_words("bob wrote:\n> x\nmine\n-- \nsig") == "mine" and forum.own_words("> a [code]x[/code] b\nmine") == "mine"


def test_packing(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice([0, 1, 30, 100, 250, 99, 7])) for i in range(400)] + [(900, 1050), (901, 500), (None, 40), (None, 40), (902, None), (5, 3), (5, 3)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("bin", F.lit(1))
    rows = packing.pack_documents(df, 500).collect()
    loads, per_doc = Counter(), Counter()
    for r in rows:
        loads[r["container"]] += r["n_tokens"]
        per_doc[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, n in sizes:
        want[i] += n or 0
    assert per_doc == want and max(loads.values()) <= 500
    assert Counter(r["doc_id"] for r in rows)[900] == 3 and len(rows) == len(sizes) + 2
    assert len(loads) <= -(-sum(want.values()) // 500) + 1
    assert packing.pack_documents(df.where("false"), 500).count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    d = spark.createDataFrame([(1, "hello world", "s"), (2, None, "s"), (3, "", "s"), (None, "a b", "s"), (4, "word " * 20_000, "s")], DOCS)
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(d).collect()}
    assert got[2] == got[3] == 0 and got[1] > 1 and got[4] >= 20_000


def test_crossover_keeps_items():
    rnd = random.Random(2)
    import numpy as np

    island = packing.Island(np.array([rnd.randrange(1, 60) for _ in range(80)]), 100, 1)
    a, b = island.fresh(0.5), island.fresh(0.5)
    for _ in range(50):
        child = island.cross(a, b)
        assert sorted(i for x in child for i in x) == list(range(80)) and all(island.load(x) <= 100 for x in child)
        a, b = b, child


def test_crossover_beats_best_fit():
    """Sizes of three to a bin that best-fit decreasing cannot place: whole bins handed on by crossover do."""
    import numpy as np

    gains = 0
    for seed in range(6):
        rnd = random.Random(seed)
        sizes = []
        for _ in range(20):
            a, b = rnd.randrange(260, 380), rnd.randrange(260, 380)
            sizes += [a, b, 1000 - a - b]
        island = packing.Island(np.array(sizes), 1000, seed)
        plain = len(island.fresh(0.0))
        best = island.evolve([], 150)[0]
        assert sorted(i for x in best for i in x) == list(range(60)) and all(island.load(x) <= 1000 for x in best)
        assert island.bound == 20 <= len(best) <= plain
        gains += plain - len(best)
    assert gains > 0


def test_packing_keeps_its_laws(spark):
    pytest.importorskip("tiktoken")
    rnd = random.Random(8)
    docs = [(i, "word " * rnd.choice([0, 3, 40, 200]), "s") for i in range(60)] + [(5, "twice", "s"), (5, "twice", "s"), (None, "no id", "s"), (61, None, "s"), (62, "long " * 700, "s")]
    row = packing.laws(spark.createDataFrame(docs, DOCS), 256).first()
    assert tuple(row) == (len(docs), 0, 0, 0)
    assert tuple(packing.laws(spark.createDataFrame([], DOCS), 256).first()) == (0, 0, 0, 0)
