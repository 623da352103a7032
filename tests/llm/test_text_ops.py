"""Corpus operators on small tables: brute force, round trips, and the odd rows that tables hold."""

import hashlib
import io
import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, graph, html_text, licenses, neardup, packing, repeats, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, salt string"


def _docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), -1, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _prose(rng, n, names="abcdefgh"):
    return " ".join("".join(rng.choice(names) for _ in range(rng.randint(1, 6))) for _ in range(n))


# -- packing


def test_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|><|endoftext|> b <|endoftext|>", "<|endoftext|", "x <|ENDOFTEXT|>", "", " ", "a", "a  b", " a\n b \n\nc  ", "don't we'll  x", "ÄÖ ü ß  x", "1 2,3 4.5!! ??", "a\tb \t c", "日本 語\x1c x \x85y", "<|endoftext|> z", "é " * 50]
    rng = random.Random(3)
    texts += ["".join(rng.choice(" \n\tabÉ1.,'　") for _ in range(200)) for _ in range(60)]
    e = packing.Encoder()
    for x in texts * 2:
        assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_texts_are_encoded_in_long_slices(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, e, calls = random.Random(4), packing.Encoder(), []
    encode = e.encode
    monkeypatch.setattr(e, "encode", lambda x: calls.append(len(x)) or encode(x))
    text = _prose(rng, 60_000, "abcdefghéß.1")
    assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert 2 <= len(calls) <= 6 and max(calls) < 66_000  # words one by one would be 60,000 calls, one slice 300,000 ids
    monkeypatch.setattr(packing, "SLICE", 7, raising=False)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "É", "'s", "1", ".", " ", " ", "  ", "\n", "\x1c", "\u3000", "<|endoftext|>"]) for _ in range(120))
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_exact_and_tight(seed):
    rng, capacity = random.Random(seed), 64
    counts = defaultdict(int)
    for _ in range(rng.choice([1, 5, 400])):
        counts[rng.randint(1, capacity if seed % 2 else 40)] += 1
    plan = packing.Plan(dict(counts), capacity)
    placed = defaultdict(int)
    for bins, layout in plan.groups:
        assert bins > 0 and sum(n * k for n, k in layout) <= capacity
        assert sum(k for n, k in layout if 3 * n > capacity) <= 2
        for n, k in layout:
            placed[n] += bins * k
    assert placed == {n: c for n, c in counts.items() if c}
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert plan.sequences <= max(least, large) * 1.1 + 1


def test_packing_is_gapless_and_whole(spark):
    rng = random.Random(1)
    texts = [_prose(rng, rng.choice([0, 1, 5, 30, 200])) for _ in range(80)] + [None, "", "x" * 3, "x" * 3]
    docs = _docs(spark, texts, [None, 1, 1, *range(3, len(texts))])
    rows = packing.pack_documents(docs, 64).collect()
    want, encoder = [], packing.Encoder()
    for t in texts:
        ids = np.frombuffer(encoder.ids(t or ""), "<u4").tolist() + [2]
        cut = len(ids) % 64 or 64
        for k, part in enumerate([ids[:cut], *[ids[i : i + 64] for i in range(cut, len(ids), 64)]]):
            want.append((k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.piece, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seqs = defaultdict(list)
    for r in rows:
        assert r.length == 64 or r.piece == 0
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 64
    assert packing.pack_documents(docs.where("doc_id < -1"), 64).count() == 0


# -- decontamination


def test_wu_manber_finds_what_a_scan_finds():
    rng = random.Random(2)
    for _ in range(150):
        pats = list({bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))})
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 80)))
        want = sorted((i, k) for k, p in enumerate(pats) for i in range(len(text)) if text.startswith(p, i))
        assert sorted(decontaminate.WuManber(pats).find(text)) == want


def _brute_hits(doc, items, n=10):
    w, hit, found = _words(doc), set(), set()
    for item, text in items:
        v = _words(text)
        for i in range(max(1, len(v) - n + 1) if v else 0):
            win = v[i : i + n]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_benchmark_hits_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, _prose(rng, rng.choice([1, 3, 9, 10, 14, 30]), "abc")) for k in range(12)] + [(90, None), (91, "..."), (None, "aa bb"), (12, "Straße ÄB 12 zz")]
    texts = [_prose(rng, rng.randint(0, 60), "abc") for _ in range(20)]
    texts += [_prose(rng, 9) + " " + (items[k][1] or "").upper() + ", " + _prose(rng, 9) for k in range(12)] + [None, "", "straße äb 12 ZZ STRAßE ÄB 12 zz", texts[0]]
    docs = _docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    good = [(k, t) for k, t in items if k is not None]
    for size in (1 << 22, 60):  # one block, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = {r.doc_id: r for r in decontaminate.benchmark_hits(docs, bench).collect()}
        for i, t in enumerate(texts):
            r = rows[i]
            assert (r.n_words, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), list(r.items)) == _brute_hits(t, good), (i, t)
        kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
        assert kept == {i for i, t in enumerate(texts) if not _brute_hits(t, good)[1]}
    assert decontaminate.benchmark_hits(docs, bench.where("item_id < -1")).where("size(items) > 0").count() == 0
    assert decontaminate.benchmark_hits(docs.where("doc_id < -1"), bench).count() == 0


# -- near duplicates


def _shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _groups(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "block", "stream"), [(2, 256, 4096), (5, 3, 5)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, n, block, stream):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "STREAM", stream)
    rng, texts = random.Random(5), []
    for _ in range(6):  # a family: a text, copies, edits that drift away, and chains of edits
        base = _prose(rng, rng.choice([12, 60, 150])).split()
        texts += [" ".join(base), " ".join(base).upper()]
        chain = base
        for _ in range(14):
            edited = list(base if rng.random() < 0.5 else chain)
            for _ in range(rng.randint(1, 8)):
                edited[rng.randrange(len(edited))] = _prose(rng, 1) + "x"
            chain = edited
            texts.append(" ".join(edited))
    texts += [None, "", "  \t", "one", "ONE", "one two", "a b c", "x " * 500, "x " * 90] + [_prose(rng, 30) for _ in range(20)]
    rng.shuffle(texts)
    rows = {r.doc_id: r for r in neardup.near_duplicates(_docs(spark, texts), n).collect()}
    sets = [_shingles(t, n) for t in texts]
    for i, g in enumerate(_groups(sets)):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (len(sets[i]), g, g == i), i


def test_near_duplicates_of_odd_tables(spark):
    docs = _docs(spark, ["a b c", "a b c", "a b c", "z y x", "z y x"], [7, 7, 3, None, None])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 2).collect())
    assert got == [(-1, None, True), (-1, None, True), (3, 3, True), (7, 3, False), (7, 3, False)]
    assert neardup.near_duplicates(docs.where("doc_id < 0"), 2).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, 2, 70)


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS_PER_TASK", 20)
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


# -- repeated passages


def _brute_removed(texts, length, keep_first=False):
    """Byte sets removed from each text; first places by (index, position)."""
    seen, out = {}, [set() for _ in texts]
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    for at in seen.values():
        for i, p in at[1:] if keep_first else at if len(at) > 1 else []:
            out[i] |= set(range(p, p + length))
    return out


def _texts_with_repeats(rng):
    alphabet = "abcdefghij é"
    draw = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [draw(rng.randint(60, 300)) for _ in range(6)]
    texts = []
    for _ in range(40):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            t += draw(rng.randint(0, 120)) + (p[a:] if rng.random() < 0.6 else p[: len(p) - a])
        texts.append(t + draw(rng.randint(0, 90)))
    return [*texts, "ab" * 200, "ab" * 150, "x" * 500, "a b c " * 60, texts[3], texts[3], "", None, "short"]


@pytest.mark.parametrize(("keep_first", "group"), [(False, repeats.GROUP), (True, repeats.GROUP), (False, 1), (True, 1)])
def test_repeats_against_brute_force(spark, keep_first, group):
    length, texts = 80, _texts_with_repeats(random.Random(7))
    rows = {r.doc_id: r for r in repeats.repeated_bytes(_docs(spark, texts), length, keep_first, group=group).collect()}
    data = [(t or "").encode() for t in texts]
    for i, gone in enumerate(_brute_removed(data, length, keep_first)):
        kept = bytes(b for k, b in enumerate(data[i]) if k not in gone)
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(data[i]), len(gone), hashlib.sha256(kept).hexdigest()), i
        assert r.n_spans == sum(k - 1 not in gone for k in gone)


def test_stretches_of_a_long_text_cover_it_once(monkeypatch):
    data = bytes(random.Random(2).choice(b"abc") for _ in range(1000))
    for size in (90, 127, 5000):
        monkeypatch.setattr(repeats, "SEGMENT", size)
        first, last, anchor, _ = repeats.stretches(data, 80)
        assert [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)] == list(range(1000 - 80 + 1))
        h = repeats.gram_hashes(data)
        assert all(h[p : p + 49].min() == v for a, b, v in zip(first, last, anchor, strict=True) for p in range(a, b + 1))


def test_longest_previous_factors():
    rng = random.Random(8)
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(200))
        starts = np.arange(len(text) - 64 + 1)
        order = repeats.SuffixOrder(text, starts, 64)
        lpf, *_ = repeats.longest_previous(order, starts)
        for k, p in enumerate(order.order):
            best = max((sum(1 for _ in itertools.takewhile(lambda i, q=q, p=p: text[p + i] == text[q + i], range(64))) for q in range(p)), default=0)
            assert (lpf[k] >= 64) == (best >= 64) and lpf[k] <= max(best, 0) + 0


def test_cutting_keeps_rows_and_columns(spark):
    length, texts = 80, [t for t in _texts_with_repeats(random.Random(9)) if t is None or len(t) != 0][:30] + [None]
    docs = _docs(spark, texts)
    got = repeats.cut_later_copies(docs, length)
    assert got.schema.names == docs.schema.names
    rows = {r.doc_id: r for r in got.collect()}
    for i, gone in enumerate(_brute_removed([(t or "").encode() for t in texts], length, True)):
        data = (texts[i] or "").encode()
        kept = bytes(b for k, b in enumerate(data) if k not in gone).decode("utf-8", "ignore")
        if not gone:
            assert rows[i].text == texts[i]
        elif kept.strip():
            assert rows[i].text == kept and rows[i].n_chars == len(kept)
        else:
            assert i not in rows


def test_rows_without_id_are_deduplicated(spark):
    rng = random.Random(5)
    named, bare, near = (_prose(rng, 60) for _ in range(3))
    top = 2**63 - 1
    docs = _docs(spark, [bare, named, named, bare, bare, near, near + " end", None, "", "", named, "x y z"], [None, None, top, None, None, None, None, None, None, None, None, 4])
    got = neardup.keep_one(docs, 2)
    rows = sorted((r.doc_id or -1, r.text or "") for r in got.collect())
    assert got.schema == docs.schema
    assert [r for r in rows if r[0] > 0] == [(4, "x y z"), (top, named)]
    rest = [t for k, t in rows if k < 0]
    assert rest.count("") == 3 and rest.count(bare) == 1 and len(rest) == 5 and {near, near + " end"} & set(rest)
    cut = repeats.cut_later_copies(docs.where("text is not null"), 80)
    rows = sorted((r.doc_id or -1, r.text) for r in cut.collect())
    assert cut.schema == docs.schema and [r for r in rows if r[0] > 0] == [(4, "x y z"), (top, named)]
    rest = [t for k, t in rows if k < 0]
    assert rest.count(bare) == 1 and sum(near in t for t in rest) == 1 and len([t for t in rest if len(t) > 80]) == 2


def test_repeats_of_odd_tables(spark):
    long = "".join(random.Random(1).choice("abcdef ") for _ in range(300))
    docs = _docs(spark, [long, long, long, None], [None, 5, 5, None])
    assert sorted(r.n_removed for r in repeats.repeated_bytes(docs, 100).collect()) == [0, 300, 300, 300]
    assert repeats.repeated_bytes(docs.where("doc_id < 0"), 100).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_bytes(docs, 10)


# -- archives


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(10)
    big = "<p>" + _prose(rng, 900, "äöüabc") + "</p>"
    rows = [(1, "http://a", big), (9, "http://b", big), (4, None, big), (2, "u\r\nx", "small"), (3, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", "lost")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_archives(archives, folder, payloads=True).collect()}
    bare = got.pop(None)  # a record of its own, named by no page
    assert (bare.payload_bytes, bare.record_type, bare.refers_to, bytes(bare.payload)) == (4, "response", None, b"lost")
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 9]
    for i, _, h in rows[:-1]:
        data = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        kind = ("revisit", 9) if h is big and i != 9 else ("response", None)
        assert (r.record_type, r.refers_to) == kind and bytes(r.payload) == (data if kind[0] == "response" else b"")
    assert warc.read_archives(warc.write_archives(pages.where("page_id > 99"), folder), folder).count() == 0
    same = spark.createDataFrame([(None, "u", big), (None, "u", big), (7, "u", big), (None, "u", big + "x"), (None, "u", big + "x")], "page_id long, url string, html string")
    got = [(r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(same, folder), folder).collect()]
    assert sorted(got, key=str) == sorted([(7, "response", None), *[(0, "revisit", 7)] * 2, *[(0, "response", None)] * 2], key=str)


def test_broken_archives_are_refused():
    one = warc.record("response", "u", 1, b"x" * 3000)
    two = warc.record("revisit", "u", 2, b"x" * 3000, 1)
    assert [r["head"]["warc-type"] for r in warc.records(io.BytesIO(one + two))] == ["response", "revisit"]
    raw = zlib.decompress(one, 31)
    bomb = zlib.compress(raw + b"\0" * 10_000_000, wbits=31)  # what lies beyond the length is never inflated
    for bad in (bomb, zlib.compress(b"WARC/1.1" + b"\0" * 10_000_000, wbits=31), one[:-20], one + b"junk", zlib.compress(raw.replace(b"xxxx", b"xxyx", 1), wbits=31), zlib.compress(raw[:-3], wbits=31)):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


# -- licences


def test_base_phrases_against_brute_force(spark):
    rng, pieces = random.Random(11), ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "under the", "mit license", "cc by", "the mit license version 2"]
    texts = [" ".join(rng.choice(pieces) if rng.random() < 0.4 else _prose(rng, 2) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "mit", "UNDER THE MIT LICENSE", "under the mitK license", "cc by nc cc by nc", licenses.PASSAGES[0][0], licenses.PASSAGES[0][0].replace("free of charge ", "")]
    rows = {r.doc_id: r for r in licenses.license_scan(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, at, names = _words(t), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    names.add(label)
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert rows[len(texts) - 2].labels == "mit" and rows[len(texts) - 1].labels == "mit" and rows[len(texts) - 1].score > 0.85
    assert licenses.license_scan(_docs(spark, [])).count() == 0
    twice = licenses.license_scan(_docs(spark, ["cc by nc", "cc by nc", "a"], [1, 1, None])).collect()
    assert sorted((r.n_base, r.n_words) for r in twice) == [(0, 1), (1, 3), (1, 3)]


def test_licences_of_a_very_long_text(spark):
    began = time.perf_counter()
    (r,) = licenses.license_scan(_docs(spark, ["word some other under the mit license " * 45_000])).collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (315_000, 45_000, 3, 314_996)
    assert time.perf_counter() - began < 30  # minutes, if rows took the text along


# -- pages


PAGES = [
    ("", ""),
    ("plain text &amp; more", "plain text & more"),
    ("<p>One  two<p>three</p>", "One two three"),
    ("<script>var x='<p>no</p>'</script><style>p{}</style><p>yes</p>", "yes"),
    ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>A long sentence, with commas, and a stop.</p></article><footer>f</footer>", "T A long sentence, with commas, and a stop."),
    ("<article><header><h1>T</h1></header><p>Body text here, really.</p><div class='comments'><p>Nice, very nice!</p></div></article>", "T Body text here, really."),
    ("<div id=sidebar>x</div><div class='cookie-notice'>We use cookies.</div><div class=content><p>Main, text. And more, of it.</p></div>", "Main, text. And more, of it."),
    ("<article><p>a<b>b</b>c<br>d &#233; &nbsp; e</p><form>f<input></form><!-- no --></article>", "abc d é e"),
    ("<article><p><b>Open, text<br><p>next.</p></article><footer>x</footer>", "Open, text next."),
    ("<table><tr><td>a<td>b</table>", "a b"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


HIDDEN_PAGES = [
    ("<article><p>One, here.</p><svg viewBox='0 0 1 1' /><p>Two, here.</p><math/><p>Three.</p></article>", "One, here. Two, here. Three."),
    ("<article><p>One, <object data=x>two.</p><p>Three.</p><object data=y>no</object><p>Four.</p></article>", "One, two. Three. Four."),
    ("<article><p>One.</p><canvas id=c><p>Two.</p></article><footer>f</footer>", "One. Two."),
    ("<article><p>One<svg><title>no</title><g><text>no</text></g></svg>, two.</p><svg><path d=x><p>Three.</p></svg></article>", "One, two. Three."),
    ("<article><p>One, <object><p>no</p><div>no<svg/></object>two.</p><noscript><p>no</p></noscript><template>no</template>x</article>", "One, two. x"),
    ("<article><p>One<svg><foreignObject><div>no</div></foreignObject></svg> two.</p><p>Three.<script>no", "One two. Three."),
    ("<p>One, <canvas>no <object>no</canvas>two.</object><p>Three.", "One, two. Three."),
]


@pytest.mark.parametrize(("page", "text"), HIDDEN_PAGES)
def test_hidden_elements_end_where_they_end(page, text):
    assert html_text.main_text(page) == text


def test_scores_select_where_marks_and_scores_disagree():
    long = "A sentence of the article, with commas, and a stop. " * 5
    for share in (1, 2, 4):  # one marked part of an article of which most lies in blocks without marks
        marked, rest = f"<p>Teaser, {long * share}</p>", f"<p>Rest, {long}</p>" * 4
        for page in (f"<div class=post>{marked}</div><div>{rest}</div>", f"<article>{marked}</article><section>{rest}</section>"):
            assert html_text.main_text(page).count("Rest") == 4 and "Teaser" in html_text.main_text(page)
    paragraphs = f"<p>{long}</p>" * 4
    low = "<table class=content>" + "<tr><td>ok</td></tr>" * 8 + "</table>"
    assert "ok" not in html_text.main_text(f"<div>{paragraphs * 4}</div>{low}")
    for part in ("<ul><li>Salt</li><li>Two eggs</li></ul>", "<pre>x = 1</pre>", "<dl><dt>Term</dt><dd>Meaning</dd></dl>", "<figure><figcaption>Photo</figcaption></figure>"):
        page = f"<article><h1>T</h1><div>By Ann</div>{paragraphs}{part}{paragraphs}</article>"
        words = re.sub("<[^>]*>", " ", page).split()
        assert html_text.main_text(page).split() == words, part


def test_state_classes_and_deep_nesting():
    body = "<p>A long sentence, with commas, and a stop.</p><p>And one more, of it.</p>"
    for name in ("content has-sidebar", "post no-comments", "has-cookie-notice", "with-menu without-footer"):
        assert html_text.main_text(f"<div class='{name}'>{body}</div>") == "A long sentence, with commas, and a stop. And one more, of it.", name
    assert html_text.main_text(f"<div class=content>{body}<div class='post-comments'>Nice, very nice!</div></div>").endswith("of it.")
    tracemalloc.start()
    text = html_text.main_text("<div>" * 20_000 + "deep, text." + "</div>x" * 20_000)
    assert text.startswith("deep, text.") and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_path_scores_against_brute_force():
    """Without article tags and class names the threshold alone decides; scores are held against a plain version."""
    rng = random.Random(12)
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 30)):
            tag = rng.choice(["p", "li", "td", "div", "section", "dd"])
            words = _prose(rng, rng.choice([1, 3, 20, 60]))
            parts.append(f"<{tag}>{words}{rng.choice(['', '.', ', and so.'])}</{tag}>")
        blocks = html_text.runs("".join(parts))
        ratio = {}
        for p in {b.path for b in blocks}:
            own = [b for b in blocks if b.path == p]
            ratio[p] = (sum(len(b.text) for b in own) / len(own), sum(len(re.findall(r"[.,;:!?]", b.text)) for b in own) / len(own))
        rows = [ratio[b.path] for b in blocks]
        padded = [rows[0], *rows, rows[-1]]
        fused = []
        for i in range(1, len(padded) - 1):
            length, marks = (0.25 * padded[i - 1][k] + 0.5 * padded[i][k] + 0.25 * padded[i + 1][k] for k in (0, 1))
            fused.append(np.log1p(length) * (1 + np.log1p(marks)))
        limit = min(np.mean(fused) - 0.5 * np.std(fused), 0.5 * max(fused))
        want = [b.text for b in blocks if np.mean([f for f, c in zip(fused, blocks, strict=True) if c.path == b.path]) >= limit]
        assert [b.text for b in html_text.select(blocks)] == want


def test_pages_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, None, PAGES[2][0], "x"), (None, "u", "<" * 2000 + "a" * 5000, "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or -1, r.text[:5], r.n_chars == len(r.text)) for r in html_text.extract(pages).collect())
    assert [g[2] for g in got] == [True] * 3 and got[1][1] == "" and got[2][1] == "One t"
    assert html_text.extract(pages.where("page_id > 5")).count() == 0
