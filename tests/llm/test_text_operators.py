"""Terms, languages, packing and mixing: brute force, invariants and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftmill.llm import terms
from siftmill.llm import langid
from siftmill.llm.langid import NAMES, TextModel, address_language, identify, label_language, markup_language
from siftmill.llm.mixing import Target, largest_total, mix, route, share_report, source_name
from siftmill.llm.packing import fill_report, pack, plan_containers
from siftmill.llm.tokens import count_tokens, token_count

WORD = re.compile(r"[^\W_]+")


def brute_terms(rows):
    texts = defaultdict(set)
    loose = []
    for rid, text in rows:
        if rid is None:
            loose.append((text or "").lower())
        else:
            texts[rid.strip(" \t")].add((text or "").lower())
    occ, rec = Counter(), Counter()
    for ts in texts.values():
        for t in ts:
            occ.update(WORD.findall(t))
        rec.update(set().union(*(WORD.findall(t) for t in ts)))
    for t in loose:
        occ.update(WORD.findall(t))
    return {k: (occ[k], rec[k]) for k in occ}, len(texts)


@pytest.mark.parametrize("burst", [3, 2000])
def test_terms_match_brute_force(spark, burst):
    rng = random.Random(burst)
    vocabulary = ["a", "ab", "abc", "abcd", "été", "Straße", "日本", "x1", "don't", "#tag_y", "⭐"] + [f"w{i:x}" for i in range(300)]
    rows = [(rng.choice([None, "r0", " r1\t"]) if i % 9 == 0 else f"r{i}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(400)]
    rows += [("r5", rows[5][1])] * 3 + [("r7", None), ("r8", ""), ("long", "word " * 200_000 + "z" * 300_000)]
    df = spark.createDataFrame([(a, b, 1, "n") for a, b in rows], "rid string, text string, n int, term string").repartition(5)
    got = {r.term: (r.occurrences, r.records) for r in terms.term_statistics(df, "rid", "text", burst=burst).collect()}
    want, total = brute_terms(rows)
    assert got == want
    marks = {r.term: r.mark for r in terms.term_statistics(df, "rid", "text", burst=burst).collect()}
    assert marks == {k: "rare" if n <= 2 else "common" if n * 4 > total else None for k, (_, n) in want.items()}


def test_terms_of_nothing(spark):
    assert terms.term_statistics(spark.createDataFrame([], "r string, t string"), "r", "t").count() == 0
    assert terms.term_statistics(spark.createDataFrame([(None, None), ("a", "!!! ⭐")], "r string, t string"), "r", "t").count() == 0


def test_burst_trie_and_routes():
    trie = terms.BurstTrie(burst=2)
    words = ["", "a", "a", "ab", "abc", "abd", "abe", "b", "ba", "a" * 50, "a" * 51, "a" * 52]
    for w in words:
        trie.add(w, 1, 1)
    assert {p + s: n for p, node in trie.containers() for s, (n, _) in node.items()} == Counter(words)
    assert trie.terms == len(set(words)) and all(len(node) <= 2 for _, node in trie.containers())


def test_routes_share_out_any_vocabulary(spark):
    """5,000 first characters with 40 terms each, one deep prefix with many: no range has more than a share."""
    words = [chr(0x4E00 + i) + f"x{j}" for i in range(5_000) for j in range(40)] + ["deep/prefix/" + f"{j:05d}" for j in range(20_000)] + ["a", "ab", "", "deep"]
    rows = [(w[:1], [w[1:]], [1], [1]) for w in words]
    df = spark.createDataFrame(rows, terms.SUBTREE)
    bounds, numbers = terms._routes(df, 64, 50)
    share = len(words) // 64
    from bisect import bisect_right

    weight = Counter(numbers[bisect_right(bounds, w) - 1] for w in words)
    assert max(weight.values()) <= share and len(bounds) < 3 * 64 and sorted(numbers) == list(range(len(bounds)))
    assert [weight[i] for i in range(len(bounds))] == sorted((weight[i] for i in range(len(bounds))), reverse=True)
    batch = terms.pa.record_batch([terms.pa.array(c, t) for c, t in zip(zip(("", sorted(words), [1] * len(words), [1] * len(words))), terms._SUBTREE.types)], schema=terms._SUBTREE)
    parts = [r for b in terms._splitter(bounds, numbers)([batch]) for r in b.to_pylist()]
    assert {r["route"]: len(r["suffixes"]) for r in parts} == dict(weight)
    assert terms.pack_ranges([], 10) == ([""], [0])


@pytest.mark.parametrize("wide", [2, 64])
def test_terms_of_records_with_differing_texts(spark, monkeypatch, wide):
    monkeypatch.setattr(terms, "WIDE", wide)
    rng = random.Random(wide)
    rows = [(f"r{rng.randint(0, 40)}", " ".join(rng.choices("a b c d e ff gg hh".split(), k=rng.randint(0, 6)))) for _ in range(300)]
    rows += [("hot", f"w{i} a") for i in range(90)] + [(None, "a a")]
    df = spark.createDataFrame(rows, "rid string, text string").repartition(4)
    got = {r.term: (r.occurrences, r.records) for r in terms.term_statistics(df, "rid", "text").collect()}
    assert got == brute_terms(rows)[0]


def test_filter_misses_no_key(spark):
    import numpy as np

    keys = spark.range(30_000).select(F.xxhash64("id").alias("h"))
    held = terms.Filter.of(keys, 30_000)
    inside = np.array([r.h for r in keys.collect()])
    other = np.array([r.h for r in spark.range(10**6, 10**6 + 50_000).select(F.xxhash64("id").alias("h")).collect()])
    assert held.holds(inside).all() and held.holds(other).mean() < 0.02


def test_plan_fills_containers():
    rng = random.Random(4)
    tiers = [("s", 50), ("m", 100), ("l", 200)]
    lengths = Counter(min(200, int(rng.expovariate(0.03)) + 1) for _ in range(3000))
    batches = plan_containers(dict(lengths), tiers)
    used = Counter()
    for tier, count, slots in batches:
        assert sum(slots) <= tiers[tier][1] and (tier == 0 or max(slots) > tiers[tier - 1][1])
        for s in slots:
            used[s] += count
    assert used == lengths
    room = sum(c * tiers[t][1] for t, c, _ in batches)
    assert sum(n * c for n, c in lengths.items()) / room > 0.97
    assert plan_containers({}, tiers) == []


def test_pack_cuts_only_what_exceeds_the_capacity(spark):
    sizes = [(1, 10), (2, 0), (3, None), (4, 450), (5, 200), (6, 200), (7, -3), (8, 50), (9, 51)] + [(100 + i, i % 60 + 1) for i in range(500)]
    df = spark.createDataFrame([(i, n, "x", 0) for i, n in sizes], "item long, n int, container string, piece int")
    rows = pack(df, "item", "n", [("l", 200), ("s", 50), ("m", 100)]).collect()
    by_item, load = defaultdict(list), Counter()
    for r in rows:
        by_item[r["item"]].append(r)
        if r.container is not None:
            load[r.container, r.container_no] += r.n_tokens
    assert set(by_item) == {i for i, _ in sizes}
    for i, n in sizes:
        parts = sorted(by_item[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in parts) == max(0, n or 0)
        assert [r.n_tokens for r in parts] == ([200, 200, 50] if n == 450 else [max(0, n or 0)])
        assert all((r.container is None) == (not n or n < 1) for r in parts)
    capacity = {"s": 50, "m": 100, "l": 200}
    assert all(n <= capacity[c] for (c, _), n in load.items())
    assert len({(r.container, r.container_no, r.slot) for r in rows if r.container}) == sum(r.container is not None for r in rows)
    tiers = spark.createDataFrame(list(capacity.items()), "container string, capacity_tokens long")
    report = {r.container: r for r in fill_report(pack(df, "item", "n", list(capacity.items())), tiers).collect()}
    assert sum(r.tokens for r in report.values()) == sum(max(0, n or 0) for _, n in sizes)
    assert pack(df.limit(0), "item", "n", [("s", 5)]).count() == 0
    with pytest.raises(ValueError):
        pack(df, "item", "n", [])


def test_steps_are_balanced(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(2000)], "i long, n int")
    cost, boxes = Counter(), defaultdict(set)
    for r in pack(df, "i", "n", [("s", 50), ("l", 100)], step=8).collect():
        cost[r.container, r.step] += r.n_tokens**2
        boxes[r.container, r.step].add(r.container_no)
    assert max(map(len, boxes.values())) <= 8
    for kind in ("s", "l"):
        usual = Counter(len(b) for (k, _), b in boxes.items() if k == kind).most_common(1)[0][0]
        costs = [c for (k, s), c in cost.items() if k == kind and len(boxes[k, s]) == usual]
        assert max(costs) < 1.25 * min(costs)


def test_token_counts(spark):
    texts = ["", None, "Hello world", "Привет, мир! 日本", "a" * 250_000, "word " * 60_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(token_count("t")).collect()]
    assert got == [count_tokens(t) if t else 0 for t in texts] and got[2] == 2 and got[0] == got[1] == 0


def test_long_texts_are_cut_where_their_tokens_end(monkeypatch):
    from siftmill.llm import tokens

    rng = random.Random(13)
    alphabet = ["a", "Z", "é", "日本", "7", "１", "²", " ", "  ", "\n", "'s", "'", "!'", "...", "⭐", "don't", "e\u0301", "_", "x1y"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=60))
        whole = tokens.count_tokens(text)
        with monkeypatch.context() as m:
            m.setattr(tokens, "PART", rng.randint(1, 12))
            assert "".join(tokens._parts(text)) == text and tokens.count_tokens(text) == whole, repr(text)
    assert tokens.PATTERN == __import__("public_tokenizers").PATTERN


def test_largest_total_and_route():
    targets = [Target("a", 0.5, 1), Target("b", 0.3, 2), Target("c", 0.2, 3)]
    weights = {1: 300, 2: 100, 4: 50, 3: 200, 6: 40}
    total = largest_total(weights, targets)
    drawn = route(weights, targets, total)
    got = Counter()
    for (mask, level), parts in drawn.items():
        assert sum(n for _, n in parts) <= weights[mask]
        for i, n in parts:
            assert mask >> i & 1 and level <= targets[i].max_repeat
            got[i] += n
    assert all(abs(got[i] - total * t.share) <= 1 for i, t in enumerate(targets))
    bigger = Counter()
    for parts in route(weights, targets, int(total * 1.1)).values():
        for i, n in parts:
            bigger[i] += n
    assert any(bigger[i] < int(total * 1.1) * t.share - 1 for i, t in enumerate(targets))


def test_largest_total_against_all_subsets():
    """By the cut condition the bound is the least ratio, over sets of sources, of what they can draw to their share."""
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(1, 5)
        cuts = [rng.random() for _ in range(n)]
        targets = [Target(f"s{i}", c / sum(cuts), rng.randint(0, 4)) for i, c in enumerate(cuts)]
        weights = {rng.randrange(1, 1 << n): rng.randint(0, 5_000) for _ in range(rng.randint(1, 8))}
        room = lambda s: sum(w * max((t.max_repeat for i, t in enumerate(targets) if m & s & (1 << i)), default=0) for m, w in weights.items())
        supplied = sum(1 << i for i in range(n) if room(1 << i))
        want = min((room(s) / sum(t.share for i, t in enumerate(targets) if s >> i & 1) for s in range(1, 1 << n) if s & supplied == s), default=0)
        assert abs(largest_total(weights, targets) - want) <= n + 1
    many = [Target(f"s{i:02}", 1 / 40, 3) for i in range(40)]
    assert abs(largest_total({1 << i | 1 << (i + 1) % 40: 1000 for i in range(40)}, many) - 120_000) <= 41


def test_flow_is_cheapest():
    from siftmill.llm.mixing import _Flow

    rng = random.Random(12)
    for _ in range(60):
        n, arcs = 6, []
        for _ in range(14):
            a, b = rng.sample(range(n), 2)
            arcs.append((a, b, rng.randint(1, 4), rng.randint(0, 3)))
        flow = _Flow(n)
        placed = [flow.arc(*x) for x in arcs]
        total = flow.run(0, n - 1)
        cost = sum(flow.arcs[e ^ 1][1] * x[3] for e, x in zip(placed, arcs))
        # Single cheapest paths, one unit at a time.
        plain = _Flow(n)
        again, spent = [plain.arc(*x) for x in arcs], 0
        while True:
            d, came = {0: 0}, {}
            for _ in range(n):
                for e, (b, room, c) in enumerate(plain.arcs):
                    a = plain.arcs[e ^ 1][0]
                    if room and a in d and d[a] + c < d.get(b, 1 << 60):
                        d[b], came[b] = d[a] + c, e
            if n - 1 not in d:
                break
            at = n - 1
            while at:
                e = came[at]
                plain.arcs[e][1] -= 1
                plain.arcs[e ^ 1][1] += 1
                at = plain.arcs[e ^ 1][0]
            spent += d[n - 1]
        assert cost == spent and total == sum(plain.arcs[e ^ 1][1] for e, x in zip(again, arcs) if x[1] == n - 1) - sum(plain.arcs[e ^ 1][1] for e, x in zip(again, arcs) if x[0] == n - 1)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, f"text {i % 950}", rng.choice(["Web ", "web", "books", "wiki", None, "other"]), rng.randint(1, 40)) for i in range(1000)]
    rows += [(2000, None, "web", 5), (2001, "z", "web", None), (2002, "y", "wiki", 0)]
    df = spark.createDataFrame(rows, "id long, text string, source string, size int")
    targets = [Target("web", 0.5, 1), Target("books", 0.3, 2), Target("wiki", 0.2, 3)]
    drawn = mix(df, "id", "text", "source", "size", targets).collect()
    shares, limit = Counter(), {t.source: t.max_repeat for t in targets}
    home = defaultdict(set)
    for i, t, s, n in rows:
        if s:
            home[t].add(s.strip().lower())
    text = {r[0]: r[1] for r in rows}
    for r in drawn:
        assert 1 <= r.uses <= limit[r.source] and r.source in home[text[r.id]] and r.id < 2000
        shares[r.source] += r.uses * r.n_tokens
    assert all(abs(shares[t.source] / sum(shares.values()) - t.share) < 0.01 for t in targets)
    assert sorted(drawn) == sorted(mix(df.repartition(3), "id", "text", "source", "size", targets).collect())
    table = spark.createDataFrame([(t.source, t.share, t.max_repeat) for t in targets], "source string, target_share double, max_repeat long")
    report = share_report(mix(df, "id", "text", "source", "size", targets, total=500), table).collect()
    assert abs(sum(r.tokens for r in report) - 500) < 100 and abs(sum(r.actual_share for r in report) - 1) < 1e-9
    assert mix(df.limit(0), "id", "text", "source", "size", targets).count() == 0 and mix(df, "id", "text", "source", "size", []).count() == 0
    names = spark.createDataFrame([(" Owner reply ",), ("OWNER_REPLY",), (None,)], "s string").select(source_name("s")).collect()
    assert [r[0] for r in names] == ["owner_reply", "owner_reply", None]


SAMPLE = [
    ("en", "We waited an hour for the soup and nobody came to our table."), ("en", "The staff was friendly but the music was too loud."), ("en", "I would not go there again with my friends."),
    ("de", "Wir haben eine Stunde auf die Suppe gewartet und niemand kam."), ("de", "Die Bedienung war freundlich, aber die Musik war zu laut."), ("de", "Ich würde dort nicht noch einmal hingehen."),
    ("es", "Esperamos una hora la sopa y nadie vino a nuestra mesa."), ("es", "El personal era amable pero la música estaba muy alta."), ("es", "No volvería allí otra vez con mis amigos."),
    ("ja", "スープを一時間待ちましたが誰も来ませんでした。"), ("ja", "店員は親切でしたが音楽がうるさかったです。"),
]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(l, t) for l, t in SAMPLE] + [(None, "x"), ("en", None)], "lang string, text string")


def test_languages(spark, sample):
    en, de, es, ja = ([t for l, t in SAMPLE if l == k] for k in ("en", "de", "es", "ja"))
    docs = [
        (1, " ".join(en), "English"), (2, " ".join(de), "en"), (3, " ".join(en[:2] + de[:2]), "de-AT"), (4, " ".join([*en, es[0]]), None), (5, "", "en"), (6, None, None), (7, "⭐ 5/5 !!", "en"),
        (8, "<p>" + "</p><p>".join(es) + "</p>", " ES"), (9, "".join(ja), "jpn"), (10, es[2].upper(), "xx"), (11, " ".join(de * 3000), "und"), (12, en[1], "en"), (12, en[1], "en"),
    ]
    df = spark.createDataFrame([(i, t, l, "web" if i % 2 else None, None if i % 3 else "host", "clash") for i, t, l in docs], "id long, text string, lang string, source string, host string, segments string")
    got = {r.id: r for r in identify(df, "id", "text", "lang", "source", "host", sample).collect()}
    langs = {i: sorted(x.lang for x in r.langs) for i, r in got.items()}
    assert langs == {1: ["en"], 2: ["de"], 3: ["de", "en"], 4: ["en"], 5: [], 6: [], 7: [], 8: ["es"], 9: ["ja"], 10: ["es"], 11: ["de"], 12: ["en"]}
    assert got[2].label_lang == "en" and got[10].label_lang is None and got[3].label_lang == "de" and got[5].lang is None and got[5].confidence is None
    assert all(0 < r.confidence <= 1 for r in got.values() if r.lang)
    s = got[3].segments
    assert [x.lang for x in s] == ["en", "de"] and s[0].end == s[1].begin and s[-1].end == len(docs[2][1])
    assert identify(df.limit(0), "id", "text", "lang", "source", "host", sample).count() == 0


def test_labels(spark):
    cases = {"EN": "en", " pt_BR": "pt", "Spanish": "es", "zh-CN": None, "und": None, "": None, None: None, "fra": "fr", "ja-JP": "ja", "日本語": "ja"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert [r[0] for r in df.select(label_language("l")).collect()] == list(cases.values())


def test_declared_languages(spark):
    texts = ['<p class="a" lang="pt-BR">Oi</p>', "<div xml:lang='de'>", "see https://shop.example.fr/menu and http://x.de", "http://a.com/x.de", "lang=fr", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r) for r in df.select(markup_language("t"), address_language("t")).collect()] == [("pt", None), ("de", None), (None, "fr"), (None, None), (None, None), (None, None), (None, None)]


def test_words_and_sentences_of_blocks_are_those_of_the_patterns():
    model = TextModel(SAMPLE, list(NAMES))
    rng = random.Random(8)
    stop = re.compile(r"(?:[.!?…]+(?=\s|[\"»”’)<]|$|[^\W\d_a-zà-ÿа-яё])|[。！？]+|\n+)[\"»”’)]*")
    alphabet = ["a", "B", "é", "ñ", "я", "Ж", "日", "本", "ア", "。", ".", "!", "…", "\n", " ", "'", "’", '"', ")", "7", "_", "𝒜", "𠮷", "⭐", "\ufe0f", "-", "don't", "St.Gallen"]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 40))) + "\n"
        import numpy as np

        flags, _ = model.characters.of(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert list(zip(*(x.tolist() for x in model._spans(flags)))) == [m.span() for m in langid._WORD.finditer(text)], repr(text)
        assert model._stops(flags).tolist() == [m.end() for m in stop.finditer(text)], repr(text)


def test_marks_tags_and_long_texts(monkeypatch):
    model = TextModel(SAMPLE, list(NAMES))
    assert langid._without_tags("a<b>c<d") == "a\n\n\nc<d" and langid._without_tags("<" * 5) == "<" * 5
    assert len(model.pieces(["<" * 200_000 + "We waited an hour."])[0]) == 1  # no tag without its end, and no search from every <
    import unicodedata

    es = "No volvería allí otra vez con mis amigos."
    one, other = (model.pieces([unicodedata.normalize(f, es)]) for f in ("NFC", "NFD"))
    assert one[3].tolist() == other[3].tolist() and abs(one[6] - other[6]).max() < 1e-4
    texts = [" ".join(t for _, t in SAMPLE) * 30, None, "", "z" * 5_000, "".join(t for l, t in SAMPLE if l == "ja") * 40]
    whole = [x.tolist() for x in model.pieces(texts)]
    for block in (200, 3_000):
        monkeypatch.setattr(langid, "BLOCK", block)
        cut = [x.tolist() for x in model.pieces(texts)]
        assert cut[0] == whole[0] and cut[3:6] == whole[3:6] and cut[2] == whole[2]
    assert model.pieces([])[0].tolist() == model.pieces([None, ""])[0].tolist() == []


def test_short_sentences_and_evidence_decide_strays():
    import numpy as np

    languages = ["en", "es", "de"]

    def run(scores, words, whole, priors):
        n, at = len(scores), np.arange(len(scores)) * 10
        return langid.decide(np.array([0, n]), at, at + 10, np.array(words), np.ones(n, int), np.array(whole), np.array(scores, float), np.log(np.array([priors])), languages)

    en, es, weak = [0, -40, -40], [-20, 0, -30], [-4.5, 0, -9]
    equal = [0.4, 0.3, 0.3]
    # Sentences of three words count; inside a sentence three words are a name.
    got = run([en, es, es, en, en], [9, 3, 3, 9, 9], [True] * 5, equal)
    assert got["lang"].tolist() == [0, 1, 0] and got["listed"].tolist() == [[True, True, False]] and got["counts"].tolist() == [[3, 2, 0]]
    assert run([en, es, es, en, en], [9, 3, 3, 9, 9], [True, False, False, True, True], equal)["lang"].tolist() == [0]
    # One stray sentence doesn't add a language. A weak one is a stray only if the document's evidence speaks for it.
    assert run([en, es, en], [9, 9, 9], [True] * 3, equal)["listed"].tolist() == [[True, False, False]]
    assert run([en, weak], [9, 9], [True] * 2, [0.8, 0.1, 0.1])["lang"].tolist() == [0]
    assert run([en, weak], [9, 9], [True] * 2, [0.8, 0.198, 0.002])["lang"].tolist() == [0, 1]
    # A short text in one language is decided by all the evidence, and so are its segments.
    assert run([weak], [2], [True], [0.98, 0.01, 0.01])["lang"].tolist() == [0] and run([weak], [2], [True], equal)["lang"].tolist() == [1]


def test_held_out_accuracy():
    pq = pytest.importorskip("pyarrow.parquet")
    try:
        rows = pq.read_table("/root/testdata/sf0.01/lang_sample.parquet").to_pylist()
    except FileNotFoundError:
        pytest.skip("no test tables")
    random.Random(0).shuffle(rows)
    model = TextModel([(r["lang"], r["text"]) for r in rows[:360]], list(NAMES))
    right = 0
    for r in rows[360:]:
        _, segments = model.document(r["text"])
        right += [list(NAMES)[s[2]] for s in segments] == [r["lang"]]
    assert right >= 0.97 * len(rows[360:])
