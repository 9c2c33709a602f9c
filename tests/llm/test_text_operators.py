"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import byte_bpe, elias_fano, language, line_rules, near_text, ngram_lm, packing, pii, token_file, toxicity
from formloom.llm.common import remainder
from formloom.llm.word_bpe import encoder

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t\r", "a", "Straße ÉTÉ İstanbul ΣΑΣ é <|endoftext|> don't we'll", "你好，世界 123 4567", "x" * 30_000, "no-spaces_" * 3_000,
    "word " * 9_000, "emoji 👩‍👩‍👧   nbsp \x1c sep", "THE the The, the. (the)  the", "tabs\tand lines", "1.2.3.4 a@b.co +1 (555) 555-0100", "'s 't 're", "..,,!!",
]
SCHEMA = "doc_id long, text string, lang string, source string, score string, n_words int, found int, ids string"


def frame(spark, texts, **columns):
    rows = [(i, t, "en", "s", "x", 1, 2, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """ODD twice, once more the first rows, and rows without an id."""
    docs = frame(spark, [*ODD, *ODD])
    return docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id in (5, 6)").withColumn("doc_id", F.lit(None).cast("long")))


def empty(odd):
    return odd.where("false")


def test_byte_bpe_matches_the_library(spark, odd):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(zip(range(99), [*ODD, *ODD], strict=False))
    got = byte_bpe.encode(odd, RANKS, P.PATTERN, piece_chars=100).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            want = enc.encode_ordinary(texts[r.doc_id] or "")
            assert r.ids == want and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).where("doc_id is not null").collect()
    assert all(r.content == (texts[r.doc_id] or "").encode() for r in back)
    assert byte_bpe.encode(empty(odd), RANKS, P.PATTERN).count() == 0


def test_word_encoder_matches_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    enc, rng = encoder(WORDS), random.Random(3)
    pool = "abcDEF éÉßñÑçöÖ.,!?'-_#1234 \n\t\r Σςİ你́ "
    texts = [x for x in ODD if x] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for x in texts:
        assert list(np.frombuffer(enc.encode(x), enc.type)) == t.encode(x, add_special_tokens=False).ids, x[:80]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in [(0, 1), (1, 0), (1, 1 << 40), (5000, 100), (5000, 1 << 45), (700, 700)]:
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        data = elias_fano.encode(v)
        s = elias_fano.Sequence(data)
        assert len(s) == n and (s.all() == v).all()
        assert all(s[i] == int(v[i]) for i in range(0, n, max(1, n // 50)))
        if n == 5000:
            assert len(data) * 8 < n * (4 + max(0, np.log2((top + 1) / n))) + 8000
    with pytest.raises(IndexError):
        s[700]


def test_token_file_reads_back_what_it_wrote(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_DOCS", 4)
    path = f"file://{tmp_path}/ids"
    token_file.write(odd, path, WORDS)
    got = token_file.read(spark, path).orderBy("start").collect()
    enc, texts = encoder(WORDS), dict(enumerate([*ODD, *ODD]))
    assert len(got) == odd.count() and [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id is not None:
            assert r.ids[:-1] == list(np.frombuffer(enc.encode(texts[r.doc_id]), enc.type))
        at += r.n_tokens
    token_file.write(empty(odd), f"{path}-none", WORDS)
    assert token_file.read(spark, f"{path}-none").count() == 0


@pytest.mark.parametrize("fan_in", [64, 2])
def test_packing_places_each_id_once(spark, odd, fan_in):
    enc, texts = encoder(WORDS), dict(enumerate([*ODD, *ODD]))
    got = packing.pack(odd.where("doc_id > 2").repartition(5), WORDS, size=256, open_windows=3, cut_room=8, fan_in=fan_in).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, pieces in by_doc.items():
        ids = [i for r in sorted(pieces, key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*np.frombuffer(enc.encode(texts[doc_id]), enc.type).tolist(), 2]
        assert all(r.doc_tokens == len(ids) for r in pieces)
    assert set(by_doc) == set(range(3, 2 * len(ODD)))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 0.05 * 256 * len(by_sequence)
    assert packing.pack(empty(odd), WORDS).count() == 0


def test_lm_counts_and_paths(spark, odd):
    held = remainder("doc_id", 10) == 0
    a = ngram_lm.score(odd, held).orderBy("doc_id", "n_tokens", "score").collect()
    b = ngram_lm.score(odd, held, broadcast_bytes=0).orderBy("doc_id", "n_tokens", "score").collect()
    assert a == b and len(a) == odd.count()
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    words = [(i, [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w] + [""]) for i, t in texts]
    counts = {}
    for i, ws in words:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {i: (sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws), len(ws), sum(w in counts for w in ws)) for i, ws in words}
    for r in a:
        if r.doc_id is not None:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][1:], n)
            assert r.base_score == pytest.approx(want[r.doc_id][0])
            assert r.score <= 0
    assert ngram_lm.score(empty(odd), held).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_lm_uses_pairs_learned_once(spark, broadcast_bytes):
    docs = frame(spark, ["red fox", "blue owl", "red fox", "red owl"])
    got = {r.doc_id: r for r in ngram_lm.score(docs, F.col("doc_id") > 1, broadcast_bytes).collect()}
    # learned once: red, fox, blue, owl, and the end twice; 6 tokens, 5 kinds
    word, end = 1.1 / 6.6, 2.1 / 6.6
    red_fox = [0.2 * 1 / 2 + 0.8 * word, 0.2 + 0.8 * word, 0.2 + 0.8 * end]
    red_owl = [red_fox[0], 0.8 * word, red_fox[2]]
    assert got[0].score == got[2].score == pytest.approx(np.log10(red_fox).sum())
    assert got[3].score == pytest.approx(np.log10(red_owl).sum())


def test_filter_holds_pairs_seen_once():
    h = np.arange(50_000, dtype=np.uint64)
    f = ngram_lm.LogFrequencyFilter.of(h, np.ones(50_000, np.int64))
    got = f.probe(h)
    assert (got >= 1).all() and (got > 1).mean() < 0.02
    assert (f.probe(np.arange(1 << 40, (1 << 40) + 500_000, dtype=np.uint64)) > 0).mean() < 0.0001


def test_filter_keeps_levels():
    h = np.arange(20_000, dtype=np.uint64)
    c = np.random.default_rng(2).zipf(1.5, 20_000).clip(2, 10**9)
    f = ngram_lm.LogFrequencyFilter.of(h, c)
    level = ngram_lm.levels(c)
    got = f.probe(h)
    assert (got >= level).all() and (got > level).mean() < 0.02
    assert (f.probe(h + np.uint64(1 << 40)) > 1).mean() < 0.002
    q = ngram_lm.EXPECTED[level]
    assert (abs(q - c) <= 0.5 * c + 1).all()


def brute_groups(texts, threshold=0.8):
    def grams(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    sets = [grams(t) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def near_texts():
    rng, out = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 9)}"
            out.append(" ".join(copy))
    return [*out, *out[:5], None, "", "one two", "one two", "One  two", *[f"p q r s t u v w x {i}" for i in range(40)]]


@pytest.mark.parametrize("block", [256, 4])
def test_near_text_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK", block)
    texts = near_texts()
    links = brute_groups(texts)
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    docs = frame(spark, texts)
    for r in near_text.join(docs).collect():
        assert r.n_links == sum(r.doc_id in x for x in links), texts[r.doc_id]
        assert r.component_id == root[r.doc_id] and r.kept == (root[r.doc_id] == r.doc_id)
        assert r.class_id == (texts.index(texts[r.doc_id]) if (texts[r.doc_id] or "").split() else r.doc_id)
    stay = {r.doc_id for r in near_text.deduplicate(docs.union(docs.where("doc_id < 9"))).collect()}
    assert stay == {i for i in range(len(texts)) if root[i] == i}
    assert near_text.deduplicate(docs.union(docs)).where("doc_id = 0").count() == 1
    assert near_text.join(docs.where("false")).count() == 0


def test_pruning_needs_many_equal_values():
    least = near_text.least_matches(0.8, 1e-5)
    assert least[0] == 0 and least[96] >= 56 and all(a <= b for a, b in zip(least, least[1:], strict=False))


def test_language_of_small_tables(spark, odd):
    words = {"en": "the and with that from this", "de": "der und mit dass von dieser", "fr": "les et avec que dans cette"}
    rows = [(i, " ".join(random.Random(i).choices(words[x].split(), k=30)), x) for i in range(60) for x in [list(words)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.fit(docs, remainder("doc_id", 5) != 0)
    assert [x for x, _ in samples] == ["de", "en", "fr"]
    got = language.identify(docs, samples, keep=True).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)
    strange = {r.doc_id: r for r in language.identify(odd, samples).collect()}
    assert all(strange[i].lang_pred == "und" and strange[i].score == 0 for i in (0, 1, 2, 3, 15))
    assert language.identify(docs, ()).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.fit(docs.where("false"), F.lit(True)) == ()


def test_language_learns_from_long_texts_only(spark):
    words = {"en": "the and with that from this", "de": "der und mit dass von dieser"}
    own = lambda i, x, k: " ".join(random.Random(i).choices(words[x].split(), k=k))
    rows = [(i, "1 " * 10_000 * (i % 4 // 2) + own(i, x, 6_000 if x == "de" else 30), x) for i in range(40) for x in [list(words)[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > 16_384 for _, t, x in rows if x == "de")
    samples = language.fit(docs, F.lit(True))
    assert [x for x, _ in samples] == ["de", "en"] and all(0 < len(s) < 65_536 + 16_384 + 2 for _, s in samples)
    assert all(r.lang_pred == r.lang for r in language.identify(docs, samples, keep=True).collect())
    assert [x for x, _ in language.fit(docs.where("lang = 'de'"), F.lit(True))] == ["de"]


def test_cross_parsing_takes_longest_matches():
    text = "abracadabra alakazam"
    a = language.SuffixAutomaton(text)
    rng = random.Random(4)
    for _ in range(200):
        x = "".join(rng.choice("abrcdlkz qy") for _ in range(rng.randint(0, 30)))
        n, at = 0, 0
        while at < len(x):
            k = 1
            while at + k <= len(x) and x[at : at + k] in text:
                k += 1
            at, n = at + max(1, k - 1), n + 1
        assert a.phrases(x) == n, x


def test_toxicity_learns_words(spark, odd):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        text = " ".join(rng.choices([f"word{k}" for k in range(60)], k=20) + (["idiotic"] if toxic else []))
        rows.append((i, text))
        labels.append((i, int(toxic), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0), (7, 0, 0), (7, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, marks, remainder("doc_id", 5) != 0, fit_rows=200)
    got = toxicity.score(docs, model, keep=True).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) and 0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd, model, keep=True).count() == odd.count()
    none = toxicity.fit(docs, marks.where("false"), F.lit(True))
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}


def test_line_rules_on_odd_texts(spark, odd):
    got = line_rules.judge(odd).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept for r in got if not r.text)
    own = [chr(97 + i % 26) * (1 + i // 26) for i in range(40)]
    texts = [f"Shared  line number {i} here\n" + " ".join(f"{w}{chr(97 + j % 26)}{j // 26 * 'z'}" for j in range(60 if i % 2 else 1)) + "\n" + "again " * 60 for i, w in enumerate(own)]
    rows = {r.doc_id: r for r in line_rules.judge(frame(spark, [*texts, texts[1]]), least=5).collect()}
    assert len(rows) == 41 and all(r.removed_words == 65 and not r.base_failed == bool(r.doc_id % 2 or r.doc_id == 40) for r in rows.values())
    assert all("hared" not in r.clean_text and "again" not in r.clean_text for r in rows.values())
    assert all(r.kept == bool(r.doc_id % 2 or r.doc_id == 40) for r in rows.values())
    assert line_rules.judge(odd.where("false")).count() == 0


def test_line_limit_is_the_same_in_every_host(spark):
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    shared = "Shared line of every host\n" + " ".join(["boiler"] + [f"p{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(150)]) + "\n"
    rows = [(h * 10_000 + i, ("" if i >= n else shared) + own(i), f"host{h}") for h, n, size in [(0, 30, 40), (1, 30, 1_600), (2, 20, 40)] for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.judge(docs).groupBy("source").agg(F.count_if(F.col("removed_words") > 0).alias("cut"), F.count_if(~F.col("kept")).alias("gone")).collect()
    assert {r.source: (r.cut, r.gone) for r in got} == {"host0": (30, 30), "host1": (30, 30), "host2": (0, 0)}


def test_pii_base_is_the_plain_patterns(spark, odd):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def fine(k, x):
        d = [int(c) for c in x if c in "0123456789"]
        if k == 1:
            return all(int(p) <= 255 for p in x.split("."))
        if k == 2:
            twice = [(2 * c - 9 * (c > 4)) if i % 2 else c for i, c in enumerate(reversed(d))]
            return 14 <= len(d) <= 19 and sum(twice) % 10 == 0
        return k == 0 or 10 <= len(d) <= 15

    rng = random.Random(8)
    texts = ["".join(rng.choice("a_@.-+ 0123459()%") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["a@b.c-d_e@f.gh", "x@y@z.com", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "+1 (555) 555-0100)", "0000000001.2.3.4", "1" * 9000]
    for t in texts:
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if fine(k, m.group()) if len(m.group()) < 200)
        assert pii.base_spans(t) == want, t[:200]
    assert pii.extract(odd, keep=True).count() == odd.count()
    assert pii.extract(empty(odd)).count() == 0


def test_pii_context_finds_unseen_numbers(spark):
    texts = [f"call desk: +1 ({200 + i}) 555-01{i:02d} now" for i in range(30)] + ["call desk: 555-0199 now", "weighs 555-0199 grams", "call desk: lots now"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in pii.extract(docs, keep=True).collect()}
    assert got[30].spans == "phone:11:19" and got[30].n_phone == 0 and got[31].spans == "" and got[32].spans == ""
    whole = frame(spark, [f"write to a{i}@b{i}.com please" for i in range(20)] + ["write to " + "a" * 90 + "(at)" + "b" * 90 + " please"])
    assert {r.doc_id: r.spans for r in pii.extract(whole).collect()}[20] == f"email:9:{9 + 90 + 4 + 90}"
    masked = {r.doc_id: r.text for r in pii.mask(pii.extract(docs, keep=True)).collect()}
    assert masked[0] == "call desk: [PHONE] now" and masked[30] == "call desk: [PHONE] now" and masked[31] == texts[31]


def test_pii_found_numbers_lead_to_further_contexts(spark):
    texts = [f"call desk: +1 ({200 + i}) 555-01{i:02d} now" for i in range(60)]
    texts += [f"call desk: 555-02{i:02d} now" for i in range(8)] + [f"my hotline 555-02{i:02d} again" for i in range(8)]
    texts += ["my hotline 555-0377 again", "weighs 555-0378 grams"]
    got = {r.doc_id: r.spans for r in pii.extract(frame(spark, texts)).collect()}
    assert all(got[60 + i] for i in range(8)) and all(got[68 + i] == "phone:11:19" for i in range(8))
    assert got[76] == "phone:11:19" and got[77] == ""


def plainly_trusted(edges, rounds, least_seeds, least_confidence):
    """The patterns to trust, by loops over all edges."""
    total, score, good = {}, {(k, v): 1.0 for k, p, v, seed in edges if seed}, set()
    for k, p, v, _ in edges:
        total[p] = total.get(p, 0) + 1
    while True:
        seeds, own = {}, {}
        for k, p, v, _ in edges:
            if (k, v) in score:
                seeds[k, p], own[k, p] = seeds.get((k, p), 0) + 1, own.get((k, p), 0.0) + score[k, v]
        part = {x for x, n in seeds.items() if n >= least_seeds}
        c = {x: own[x] / (total[x[1]] + 1) for x in part}
        rest = [(k, p, v) for k, p, v, _ in edges if (k, v) not in score and (k, p) in part]
        for _ in range(rounds):
            best = {}
            for k, p, v in rest:
                best[k, v] = max(best.get((k, v), 0.0), c[k, p])
            c = {x: (own[x] + sum(best[k, v] for k, p, v in rest if (k, p) == x)) / (total[x[1]] + 1) for x in part}
        sure = {x for x in part if c[x] >= least_confidence}
        good |= sure
        fresh = {}
        for k, p, v in rest:
            if (k, p) in sure:
                fresh[k, v] = max(fresh.get((k, v), 0.0), c[k, p])
        if not fresh:
            return good
        score |= fresh


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_patterns_are_scored_as_by_loops(spark, seed):
    rng = random.Random(seed)
    chains = [("phone", f"p{j}", f"v{i}", i < 8) for j in range(5) for i in range(6 * j, 6 * j + 9)]
    noise = [(k, f"q{rng.randint(0, 9)}", v, v < "v3") for k in ("phone", "card") for v in (f"v{rng.randint(0, 60)}" for _ in range(120))]
    edges = sorted(set(chains + noise))
    edges = list({(k, p, v): (k, p, v, any(s for a, _, b, s in edges if (a, b) == (k, v))) for k, p, v, _ in edges}.values())
    graph = spark.createDataFrame(edges, "kind string, pattern string, value string, seed boolean")
    for rounds, least, confidence in ((0, 3, 0.6), (2, 3, 0.55), (2, 2, 0.3)):
        got = [tuple(r) for r in pii.trusted(graph, rounds, least, confidence).collect()]
        assert len(got) == len(set(got)) and set(got) == plainly_trusted(edges, rounds, least, confidence)
        assert got
