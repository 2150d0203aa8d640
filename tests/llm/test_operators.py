"""The ten operators against brute force, libraries and round trips, on small fixtures with odd rows."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vigil.llm import toxicity, urls
from vigil.llm.jaccard import jaccard_components
from vigil.llm.language import language_samples, predict_languages
from vigil.llm.lines import drop_repeated_lines
from vigil.llm.neardup import near_duplicates
from vigil.llm.packing import closest, pack_documents, pack_lengths
from vigil.llm.pieces import decode, encode
from vigil.llm.topk import top_inner_products
from vigil.llm.transducer import count_tokens

DOCS = "doc_id long, text string, run string, ids int"


def odd_texts(seed: int, count: int) -> list[str | None]:
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "'s", "'LL", "7", "é", "×", " ", " ", "!!", "<|endoftext|>", "<s>", "日本", "\x1d", "word", "the", " " * 20]
    return [None, "", " ", *("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(count))]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def grouped(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "One TWO", "one two", "solo"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(6, 80))]
        for _ in range(rng.randint(1, 8)):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = f"z{rng.randint(0, 99)}"
            texts.append(" ".join(near))
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {(k, len(s), r) for k, (s, r) in enumerate(zip(sets, grouped(len(sets), linked), strict=True))}
    docs = frame(spark, texts)
    assert {tuple(r) for r in jaccard_components(docs).collect()} == want
    twice = jaccard_components(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(texts) and {tuple(r) for r in twice} == want
    nameless = spark.createDataFrame([(None, "one two", "x", 1), (3, "one two", "x", 1)], DOCS)
    assert {tuple(r) for r in jaccard_components(nameless).collect()} == {(None, 1, None), (3, 1, 3)}
    assert jaccard_components(docs.limit(0)).count() == 0


def test_url_rules_and_model(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    rows = [(1, "http://a.Example.org/en/12?x", "h"), (2, "https://example.org/es", "h"), (3, "http://x.com/de/a#b", "h"), (4, None, "h"), (5, "no scheme", "h"), (6, "http://notexample.org.net/es/", "h"), (7, "http://m.cheap-pills.example.net/en/8", "h"), (8, "http://www.music.example.net/en/8", "h"), (9, "x://HOST?q", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    model = urls.fit(urls.labelled_urls(spark))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, model).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/es", "org/", "allow")
    assert got[3] == ("x.com", "/de/a", "com/de/", "block")
    assert got[4][:3] == got[5][:3] == ("", "", None) and got[6][2] is None and got[9][:3] == ("host", "", None)
    assert got[7][3] == "block" and got[8][3] == "allow"
    assert urls.judge(pages.limit(0), rules, model).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        rows += [(c % 3, (centre + 0.2 * rng.standard_normal(32)).astype(np.float32).tolist()) for _ in range(8)]
    rows += [(0, rows[0][1]), (1, rows[1][1]), (None, rows[2][1]), (0, None), (0, []), (0, [0.0] * 32), (0, [float("nan")] * 32), (0, [None] * 32), (0, [1.0, 2.0])]
    return [(k, e, y, "x") for k, (y, e) in enumerate(rows)]


def usable(e):
    return bool(e) and all(v is not None and np.isfinite(v) for v in e)


def test_near_duplicates_equal_brute_force(spark):
    rows = vectors(1)
    linked = []
    for a, x, y, _ in rows:
        for b, u, v, _ in rows[:a]:
            if y is not None and y == v and usable(x) and usable(u) and len(x) == len(u) and np.any(x) and np.any(u):
                p, q = np.array(x, float), np.array(u, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    linked.append((a, b))
    root = grouped(len(rows), linked)
    want = {(k, sum(k in pair for pair in linked), root[k], root[k] == k) for k in range(len(rows))}
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string")
    assert len(linked) > 30
    assert {tuple(r) for r in near_duplicates(data).collect()} == want
    assert near_duplicates(data.limit(0)).count() == 0


def test_near_duplicates_copy_no_vector_and_broadcast_nothing(spark, monkeypatch):
    """Blocks meet where they are read, whatever their number, and no side of a join is sent to all tasks."""
    from vigil.llm import links, neardup

    data = spark.createDataFrame(vectors(1), "vec_id long, embedding array<float>, label int, block string")
    whole = {tuple(r) for r in near_duplicates(data).collect()}
    for name, value in (("BLOCK", 7), ("PIECE", 3), ("ROWS", 40)):
        monkeypatch.setattr(neardup, name, value)
    plans, real = [], neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, name="cut": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    out = near_duplicates(data)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {tuple(r) for r in out.collect()} == whole
    found = dict(plans)["links"]
    assert "CartesianProduct" in found and "Exchange" not in found and "Generate" not in found
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    plans.append(("star", links._towards_least(edges)._jdf.queryExecution().executedPlan().toString()))
    assert not any("BroadcastExchange" in p for _, p in plans)


def test_top_products_equal_brute_force(spark):
    rows = vectors(2)
    good = [(k, np.floor(256 * np.array(e, float)).astype(int)) for k, e, _, _ in rows if usable(e)]
    want = set()
    for q, x in good:
        if q % 7 == 0:
            best = sorted((-int(x @ y), k) for k, y in good if k != q and len(x) == len(y))[:5]
            want |= {(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)}
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard string")
    assert {tuple(r) for r in top_inner_products(data, "vec_id % 7 = 0").collect()} == want
    assert top_inner_products(data.limit(0)).count() == 0


def test_sentencepiece_parity_and_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [*odd_texts(3, 200), "▁x"]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = encode(frame(spark, texts), path)
    rows = decode(coded, path).orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        assert np.frombuffer(row.ids, np.uint32).tolist() == library.encode(text or "")
        assert row.parity
        assert row.round_trip == ("▁" not in (text or ""))
        assert row.decoded == (text or "").replace("▁", " ")
    assert encode(frame(spark, texts).limit(0), path).count() == 0


def test_packing_covers_every_token_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*odd_texts(4, 150), "long text " * 3000]
    pieces = pack_documents(frame(spark, texts), path).collect()
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == k)
        assert b"".join(b for _, b in own) == np.array(ids, np.uint32).tobytes()
        assert all(p.doc_tokens == len(ids) for p in pieces if p.doc_id == k)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, len(p.ids) // 4))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at & (at - 1) == 0 or at >= 2048 * 15 / 16)
    assert pack_documents(frame(spark, texts).limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_closest_sum_equals_enumeration(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
    room = rng.randint(1, 90)
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * j for s in sums for j in range(c + 1)}
    found = closest(counts, room)
    assert sum(n * c for n, c in found) == max(s for s in sums if s <= room)
    assert all(c <= counts[n] for n, c in found)


def test_pack_lengths_uses_each_once():
    lengths = [random.Random(1).randint(1, 2047) for _ in range(500)]
    packed = pack_lengths(lengths)
    assert sorted(k for p in packed for k in p) == list(range(500)) and max(sum(lengths[k] for k in p) for p in packed) <= 2048


@pytest.mark.parametrize("written", ["1d10t", "i.d.i.o.t", "i d i o t", "idiooot", "!di0t"])
def test_disguised_words_are_restored(written):
    trigrams = np.zeros((27, 27, 27))
    for word in ["idiot", "the", "little", "lot", "old", "tilt"] * 20:
        codes = [26, 26, *(ord(c) - 97 for c in word), 26]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            trigrams[a, b, c] += 1
    assert list(toxicity.restored_spans(f"some {written} here", toxicity.Decoder(trigrams.ravel()))) == ["idiot"]


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["river", "stone", "cloud", "grass", "house", "paper"]) + rng.choice("abcdefgh") for _ in range(30))
    texts = [plain() + (" you idiot " if k % 4 == 0 else " ") + plain() for k in range(120)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate([*texts, None, "", "such an 1d10t"])], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    trigrams = toxicity.letter_trigrams(docs)
    lexicon = toxicity.learn(toxicity.training_rows(docs, labels, "doc_id % 3 <> 1"), trigrams)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, lexicon, trigrams).collect()}
    assert all((got[k] >= 0.7) == (k % 4 == 0) for k in range(120))
    assert got[120] < 0.7 and got[121] < 0.7 and got[122] >= 0.7
    assert toxicity.learn(toxicity.training_rows(docs, labels.limit(0), "true"), trigrams) == {}
    assert {r.score for r in toxicity.score_texts(docs, {}, trigrams).collect()} == {0.02}


def test_repeated_lines_go_after_their_first_place(spark):
    texts = ["a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "a\nb", None, "", "\n\n\n\n", "p\nq\nr\np\nq\nr"]
    rows = drop_repeated_lines(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["a\nb\nc\nd\ne", "x\ny", "a\nb", None, "", "\n\n\n\n", "p\nq\nr"]
    assert [r.n_removed for r in rows] == [0, 4, 0, 0, 0, 0, 3] and [r.n_lines for r in rows] == [5, 6, 2, 0, 1, 5, 6]
    assert drop_repeated_lines(frame(spark, texts).limit(0)).count() == 0


def test_languages_on_held_out_texts(spark):
    words = {"aa": ["tion", "ment", "the", "of"], "bb": ["schaft", "ung", "der", "und"], "cc": ["ción", "ado", "que", "los"]}
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choices(words[x], k=rng.randint(1, 3))) for _ in range(30)), x) for k, x in enumerate(["aa", "bb", "cc"] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 ... !", "bb"), (902, "", None)], "doc_id long, text string, lang_pred string").withColumnRenamed("lang_pred", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(docs, language_samples(docs.where("doc_id % 3 <> 5 and doc_id < 60"))).collect()}
    assert all(got[k][0] == x and 0 <= got[k][1] <= 1 for k, _, x in rows)
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert {r.lang_pred for r in predict_languages(docs, {}).collect()} == {"und"}


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*odd_texts(6, 300), "x" * 5000, "word " * 5000]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame(spark, texts), path).collect()}
    for k, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[k] == (len((text or "").encode()), n, n > 2048)
    assert zlib.crc32(b"") == 0 and count_tokens(frame(spark, texts).limit(0), path).count() == 0


def few_words():
    trigrams = np.zeros((27, 27, 27))
    for word in ["idiot", "trash", "kill", "ass", "dumbass", "the", "little", "lot", "old", "as", "tilt"] * 20:
        codes = [26, 26, *(ord(c) - 97 for c in word), 26]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            trigrams[a, b, c] += 1
    return toxicity.Decoder(trigrams.ravel())


@pytest.mark.parametrize(("written", "word"), [("idi07", "idiot"), ("a$$", "ass"), ("dumba$$", "dumbass"), ("ki11", "kill"), ("idio+", "idiot"), ("1dio+", "idiot"), ("tras#", "trash"), ("1diot!!!", "idiot"), ("i.d. i.o. t", "idiot"), ("€old", "eold"), ("i. d.i. o.t", "idiot")])
def test_disguises_at_the_end_and_with_mixed_separators(written, word):
    decoder = few_words()
    for around in ("{}", "such {} here", "é {}\n", '"{}".'):
        assert word in list(toxicity.restored_spans(around.format(written), decoder))


def test_search_near_suspicious_places_finds_every_span():
    rng = random.Random(7)
    letters, odd = "abdiotks", [*toxicity.ALIKE, *toxicity.SEPARATORS, "é", "í", "日", "\n", "  ", "!!"]
    for _ in range(4000):
        text = ""
        while len(text) < rng.choice((5, 60, 400)):
            kind = rng.random()
            if kind < 0.4:
                text += "".join(rng.choices(letters, k=rng.randint(1, 9))) + " "
            elif kind < 0.6:
                text += "".join(rng.choice(letters) + "".join(rng.choices(toxicity.SEPARATORS, k=rng.randint(1, 2))) for _ in range(rng.randint(2, 18))) + rng.choice(letters)
            elif kind < 0.9:
                text += "".join(rng.choice(odd) if rng.random() < 0.4 else rng.choice(letters) for _ in range(rng.randint(1, 30)))
            else:
                text += "plain words of no interest whatever " * rng.randint(1, 4)
        near = [m.group() for part in toxicity.suspicious(text) for m in toxicity.SPANS.finditer(part)]
        assert near == [m.group() for m in toxicity.SPANS.finditer(text)], ascii(text)


def test_toxicity_learns_rare_words_and_adds_weak_ones(spark):
    rng = random.Random(4)
    common = ["river", "stone", "cloud", "grass", "house", "paper"]
    plain = lambda: [rng.choice(common) + rng.choice("abcdefgh") for _ in range(20)]
    insults = ["".join(rng.choices("bdfgklmnprtz", k=7)) for _ in range(60)]
    bad = [[*plain(), w, *(x for x in ("weakling", "grumbler") if rng.random() < 0.3)] for w in insults * 8]  # 1.7 % of the toxic texts each
    good = [[*plain(), *(x for x in ("weakling", "grumbler") if rng.random() < 0.06)] for _ in range(1500)]
    rows = [(k, " ".join(w), int(k < len(bad))) for k, w in enumerate([*bad, *good])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    trigrams = toxicity.letter_trigrams(docs)
    lexicon = toxicity.learn(toxicity.training_rows(docs.drop("toxic"), docs.select("doc_id", "toxic"), "true"), trigrams)
    new = [*insults, "weakling", "grumbler", "weakling and grumbler", "weakling weakling weaklings", *common]
    texts = spark.createDataFrame([(k, f"the {w} there") for k, w in enumerate(new)], "doc_id long, text string")
    got = {new[r.doc_id]: r.score for r in toxicity.score_texts(texts, lexicon, trigrams).collect()}
    assert all(got[w] >= 0.7 for w in [*insults, "weakling and grumbler"])
    assert all(0.02 < got[w] < 0.7 for w in ("weakling", "grumbler", "weakling weakling weaklings")) and {got[w] for w in common} == {0.02}


def test_phrases_equal_naive_longest_matches():
    from vigil.llm.language import Model, cross_entropies, plain

    rng = random.Random(11)
    words = {f"l{k}": ["".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(40)] for k, alphabet in enumerate(["abcd", "bcde", "àéabc", "日本語中文字", "αβγab", "abxyz", "мирта", "efgh", "ghij", "kabc", "opqr", "стри"])}
    samples = {name: " ".join(rng.choices(w, k=120)) for name, w in words.items()}
    model = Model(samples)
    texts = [plain(" ".join(rng.choices(w, k=30)) + rng.choice(["", " q¡", "zzz"])) for w in words.values()]

    def longest(text, at, sample):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        return size

    def naive(text, sample):
        """Longest matches from the left; a character that the sample lacks opens a phrase with the match after it."""
        at = phrases = 0
        while at < len(text):
            at += longest(text, at, sample) or 1 + longest(text, at + 1, sample)
            phrases += 1
        return phrases + (text[0] not in sample)

    from vigil.llm.language import Automaton

    automata = [Automaton(model.encode(samples[x]), model.symbols) for x in model.languages]
    got = cross_entropies(texts, model, automata)
    for k, text in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert got[k, j] * len(text) / automata[j].bits == pytest.approx(naive(text, samples[name]))


def test_signs_are_no_letters(spark):
    samples = {"xx": "ab " * 20}
    docs = spark.createDataFrame([(1, "²½①Ⅷ"), (2, "a²"), (3, "٣٤ _"), (4, None), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in predict_languages(docs, samples).collect()}
    assert found == {1: "und", 2: "xx", 3: "und", 4: "und", 5: "und"}


def test_lines_of_a_very_long_copied_text(spark):
    """50,000 lines twice, and a copy between other lines: linear in the lines, whole results."""
    body = "\n".join(f"line {i}" for i in range(50_000))
    rows = drop_repeated_lines(frame(spark, [body, body, "first\n" + body + "\nlast"])).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0, 50_000, 50_000]
    assert [r.text for r in rows] == [body, "", "first\nlast"]
