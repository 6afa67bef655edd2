"""The ten operators against brute force, exact round trips or held-out rows, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import bpe, fingerprints, jaccard, langid, packing, quality, sharding, substrings, toxicity, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}a" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with scratch names."""
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "one two three", prose(rng, 60), prose(rng, 60), "x" * 30_000, prose(rng, 20_000), "é ß ñ. 中文 字", "the end"]
    rows = [(i, t, "en", "s", 1, "clash", 7) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1, "clash", 7), (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", __words string, length int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# sharding


def jump(key, shards):
    b, j = -1, 0
    key %= 1 << 64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [*range(300), -5, 2**62, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for shards in (1, 8, 9):
        assert {r.doc_id: r.shard for r in sharding.assign(df, shards).collect()} == {k: jump(k, shards) for k in keys}


def test_slots_have_no_gaps(spark, odd, none):
    found = sharding.slots(sharding.assign(odd, 3), rows_per_bucket=2).collect()
    assert len(found) == odd.count()
    for s in {r.shard for r in found}:
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.slots(sharding.assign(none, 3)).count() == 0


# quality


def brute_quality(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})


def test_quality_features(spark, odd):
    texts = ["a b c a b c a b", "a a a a a", "#x $\n#x $\n\nz", None, "", "a\x0bb\x0cc", "u v", prose(random.Random(1), 500)]
    df = table(spark, texts)
    f = quality.features()
    rows = quality.with_words(df).select("doc_id", *[f[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [brute_quality(t) for t in texts]


def test_quality_filter(spark, odd, none):
    good, bad = prose(random.Random(2), 80), "too short"
    kept = quality.filter_quality(table(spark, [good, bad, None, "spam spam spam " * 50])).collect()
    assert [r.doc_id for r in kept] == [0]
    assert quality.filter_quality(odd).columns == odd.columns and quality.filter_quality(none).count() == 0


# language identification


def test_langid(spark, odd, none):
    rng = random.Random(5)
    syllables = {"aa": "ka to mi ru se".split(), "bb": "schu gen tz ber".split(), "cc": "éau ç ion lle".split()}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang, "s", 1) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(240))]
    docs = spark.createDataFrame([*rows, (1000, None, "aa", "s", 0), (1001, "12 34 !!", None, "s", 0)], DOCS)
    model = langid.fit(docs, langid.fold(4) != 2, langid.fold(4) == 3)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(found[i].lang_pred == lang and found[i].accepted for i, _, lang, _, _ in rows)
    assert (found[1000].lang_pred, found[1000].score, found[1000].accepted) == ("und", 0.0, False) == (found[1001].lang_pred, found[1001].score, found[1001].accepted)
    assert langid.identify(odd, model).count() == odd.count()
    empty = langid.fit(none, F.lit(True), F.lit(False))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"} and langid.identify(none, empty).count() == 0


def test_langid_blocks_add_up():
    rng = random.Random(1)
    model = langid.train(["ka to mi ru " * 9, "schu gen tz ber " * 9], ["a", "b"], [False, False])
    text = " ".join(rng.choice(["ka", "gen", "tz", "ru"]) for _ in range(4000))
    whole = model.logits(text)
    block, langid.BLOCK = langid.BLOCK, 777
    try:
        assert model.logits(text) == pytest.approx(whole)
    finally:
        langid.BLOCK = block


# toxicity


def test_toxicity(spark, odd, none):
    rng = random.Random(9)
    clean = [prose(rng, 40) for _ in range(120)]
    toxic = [" ".join(rng.sample([*prose(rng, 30).split(), rng.choice(["idiot", "stupid"]), rng.choice(["idiot", "stupid"])], 32)) for _ in range(60)]
    docs = table(spark, clean + toxic)
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(180)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    base = prose(random.Random(77), 30)
    for sign in ("idiot", "1d10t!", "i d i o t", "i.d.i.o.t", "Idiiiiot", "$tup1d"):
        assert model.score(f"{base} {sign} {base} {sign}") >= 0.7, sign
    assert model.score(base) < 0.5 and model.score(None) < 0.5 and model.score("") < 0.5
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    blank = toxicity.fit(docs, labels.where("false"))
    assert {r.toxicity < 0.7 for r in toxicity.score(odd, blank).collect()} == {True}


# fingerprints


def test_phrases_are_locally_consistent():
    import numpy as np

    rng = random.Random(4)
    middle = prose(rng, 400)
    found = []
    for head in ("", "x", "some other words before it "):
        text = head + middle
        symbols = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        first = np.zeros(len(symbols), dtype=bool)
        first[0] = True
        for _ in range(2):
            symbols, first = fingerprints.phrases(symbols, first)
        found.append(set(symbols.tolist()))
    for a, b in itertools.combinations(found, 2):
        assert len(a & b) / len(a | b) > 0.9
    assert fingerprints.sketches(["", "a", "aaaa", middle, middle])[3:][0] == fingerprints.sketches([middle])[0]


def test_edited_texts(spark, odd, none):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 300)) or None for _ in range(60)]
    found = {r.id: r for r in fingerprints.compared(table(spark, texts)).collect()}
    assert len(found) == 60
    for i, t in enumerate(texts):
        a, b = t or "", texts[(i + 1) % 60] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = found[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(a)
        assert [r.fingerprint, r.edited_fingerprint] == fingerprints.sketches([a, edited])
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
    assert fingerprints.compared(odd).count() == odd.count() and fingerprints.compared(none).count() == 0


# web pages

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><header>Site name</header><nav><a href=/>Home page</a></nav><div class='cookie-notice'>We use cookies</div><div class=top>Same on all pages</div>{body}<aside>Side</aside><div id=comments><p>first!</p></div><footer>&copy; {i}</footer></body></html>"


def test_wrappers(spark, none):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(40):
        paragraphs = [prose(rng, 20) for _ in range(1 + i % 4)]
        body = f"<article><h1>Title {i} &amp; more</h1><div>Share this page</div>" + "".join(f"<p>{p}\n <b>bold</b> x" for p in paragraphs) + "</article>"
        rows.append((i, f"http://h{i % 2}.example/{i}", PAGE.format(body=body, i=i)))
        truth[i] = "\n\n".join([f"Title {i} & more", *[f"{p} bold x" for p in paragraphs]])
    rows += [(100, None, None), (101, "http://alone.example/x", ""), (102, "http://alone.example/y", "<p>just text<p>more")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert {i: found[i] for i in truth} == truth
    assert (found[100], found[101], found[102]) == ("", "", "just text\n\nmore")
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_larger_than_the_articles(spark):
    rng = random.Random(12)
    rows, truth = [], {}
    menu = "<div class=top>" + "".join(f"<li>Section {i} of this site" for i in range(30)) + "</div>"
    for i in range(12):
        # pages 8 and 9 are near copies of page 7, the shortest
        paragraphs = paragraphs if i in (8, 9) else [prose(rng, 30 if i == 7 else 60) for _ in range(1 if i == 7 else 2)]
        body = f"{menu}<article><h1>Title {i}</h1><div>Share this page with all of your friends</div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
        rows.append((i, f"http://large.example/{i}", PAGE.format(body=body, i=i)))
        truth[i] = "\n\n".join([f"Title {i}", *paragraphs])
    # all pages of a host are near copies but for their titles: nothing is known of its template
    for i in range(20, 26):
        rows.append((i, f"http://copies.example/{i}", PAGE.format(body=f"<article><h1>Title {i}</h1><p>{paragraphs[0]}</p></article>", i=i)))
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: found[i] for i in truth} == truth
    assert found[22] == f"Title 22\n\n{paragraphs[0]}"


def test_matching_keeps_order():
    a, b = (wrappers.tree_of(h)[0] for h in ("<div><p>1</p><ul><li>x</ul><p>2</p></div>", "<div><ul><li>x</ul><p>2</p><p>3</p></div>"))
    pairs = [(x.tag, y.tag) for x, y in wrappers.match(a, b)]
    assert sorted(pairs) == [("#root", "#root"), ("div", "div"), ("li", "li"), ("p", "p"), ("ul", "ul")]
    tree, nodes = wrappers.tree_of("<div>a<p>1</p><ul><li>x<li>y</ul><p>2</p></div>")
    again = wrappers.nodes_from(wrappers.skeleton(tree, nodes))
    assert [(n.tag, n.digest, abs(n.size), [c.number for c in n.below]) for n in again] == [(n.tag, n.digest, n.size, [c.number for c in n.below]) for n in nodes]


def brute_matching(x, y):
    """The size of the largest simple tree matching, by trying all choices of the first children."""
    if x.tag != y.tag:
        return 0

    def best(ps, qs):
        if not ps or not qs:
            return 0
        return max(best(ps[1:], qs), best(ps, qs[1:]), brute_matching(ps[0], qs[0]) and brute_matching(ps[0], qs[0]) + best(ps[1:], qs[1:]))

    return 1 + best(x.below, y.below)


def test_matching_is_the_largest():
    rng = random.Random(13)

    def tree(depth):
        return "".join(f"<{t}>{rng.choice('ab')}{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randint(0, 3)))

    for _ in range(60):
        a, b = (wrappers.tree_of(tree(2))[0] for _ in range(2))
        pairs = wrappers.match(a, b)
        assert len(pairs) == brute_matching(a, b) and all(x.tag == y.tag for x, y in pairs)


def nameless(rng, i, article):
    """A page without telling names: a menu of the section, a constant line, the article, a notice and a foot that vary by section."""
    section = i % 5
    menu = "".join(f"<li>Section {section} item {k}" for k in range(4))
    return f"<body><div><ul>{menu}</ul></div><div>Welcome to the site</div><div>{article}</div><div>Offers of section {section} end soon</div><div>Imprint {section}</div></body>"


def test_template_without_names(spark):
    """Only what varies over the pages of a host tells the article here; without the template, all of each page would be its text."""
    rng = random.Random(21)
    rows, truth = [], {}
    for i in range(60):
        paragraphs = [prose(rng, 25) for _ in range(1 + i % 3)]
        article = f"<h2>Title {i}</h2><div>Share this with friends</div>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, f"http://plain.example/{i}", nameless(rng, i, article)))
        truth[i] = "\n\n".join([f"Title {i}", *paragraphs])
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:3])] + [(None, *rows[4][1:])]  # copies, and a row without an id
    pages = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "page_id long, url string, html string, host string, part int")
    found = wrappers.extract(pages).collect()
    assert len(found) == len(rows) and {r.page_id: r.text for r in found if r.page_id in truth} == truth
    assert {r.page_id: r.text for r in found}[1001] == truth[1] and {r.page_id: r.text for r in found}[None] == truth[4]
    assert wrappers.article_text(wrappers.tree_of(rows[0][2])[0], set()) != truth[0]


def test_wrapper_alone_finds_the_articles(spark):
    """Without names the given pages, four a host, give the texts that names and wrapper give together."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    both, alone = ({r.page_id: r.text for r in wrappers.extract(pages, names=names).collect()} for names in (True, False))
    assert len(both) == 250 and sum(both[k] == alone[k] for k in both) >= 0.95 * len(both)


def test_small_hosts_are_told_by_those_like_them(spark):
    rng = random.Random(23)
    rows, truth = [], {}
    for i in range(40):
        host = f"h{i // 2}.example"  # two pages a host
        paragraphs = [prose(rng, 25) for _ in range(2)]
        article = f"<h2>Title {i}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, f"http://{host}/{i}", f"<body><ul><li>Home<li>News {i % 3}</ul><div>{article}</div><div>Offer {i % 4} ends soon</div><div>Imprint of {host}</div></body>"))
        truth[i] = "\n\n".join([f"Title {i}", *paragraphs])
    # two pages unlike all others, of one article: nothing tells their template, so that nothing is lost
    copy = prose(rng, 40)
    rows += [(100 + i, "http://odd.example/x", f"<table><tr><td>{copy}<td>{prose(rng, 5)}</table>") for i in range(2)]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).collect()}
    assert {i: found[i] for i in truth} == truth
    assert found[100].startswith(copy) and found[101].startswith(copy)


def test_a_host_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BYTES_PER_PART", 2000)
    rng = random.Random(22)
    rows = [(i, f"http://plain.example/{i}", nameless(rng, i, f"<h2>Title {i}</h2><p>{prose(rng, 25)}</p>")) for i in range(60)]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i].startswith(f"Title {i}\n\n") and found[i].count("\n\n") == 1 for i in range(60))


def test_deep_and_long_pages(spark):
    deep = "<article>" + "<div>" * 3000 + "inside" + "</div>" * 3000 + "<p>end of the article text</p></article>"
    inline = "<p>" + "<b>" * 5000 + "bold" + "</b>" * 5000 + " plain</p>"
    long = "<article>" + "".join(f"<p>part {i}</p>" for i in range(3000)) + "</article>"
    rows = [(i, "http://d.example/x", h) for i, h in enumerate((deep, inline, long, "</div>" * 2000 + "<p>x"))]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {0: "inside\n\nend of the article text", 1: "bold plain", 2: "\n\n".join(f"part {i}" for i in range(3000)), 3: "x"}


# substring deduplication


def test_shared_passages_go_once(spark, odd, none):
    rng = random.Random(6)
    passage = prose(rng, 80)
    texts = [f"{prose(rng, 50)} {passage} {prose(rng, 50)}" for _ in range(5)] + [prose(rng, 100) for _ in range(5)]
    found = {r.doc_id: r for r in substrings.deduplicate(table(spark, texts)).collect()}
    assert found[0].text == texts[0] and not found[0].removed_spans
    for i in range(1, 5):
        assert len(found[i].text) < len(texts[i]) - 0.8 * len(passage)
        assert texts[i].startswith(found[i].text[:200]) and texts[i].endswith(found[i].text[-200:])
        cut = texts[i]
        for s in reversed(found[i].removed_spans):
            cut = cut[: s["start"]] + cut[s["end"] :]
        assert cut == found[i].text
    for i in range(5, 10):
        assert found[i].text == texts[i]
    out = substrings.deduplicate(odd)
    assert out.count() == odd.count() and substrings.deduplicate(none).count() == 0
    assert {r.doc_id: r.text for r in out.collect()}[None] == "no id here"


def test_passages_go_up_to_their_ends(spark):
    rng = random.Random(16)
    texts, kept = [], []
    for i in range(300):  # 51 short words each, in two documents
        passage = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice(["", "n", "st"]) for _ in range(51))
        for j in range(2):
            head, tail = (" ".join(f"{side}{i}x{j}y{k}" for k in range(30)) for side in "ht")
            texts.append(f"{head} {passage} {tail}" if i % 3 else f"{passage} {tail}" if i % 2 else f"{head} {passage}")
            kept.append(texts[-1] if not j else f"{head} {tail}" if i % 3 else tail if i % 2 else head)
    found = {r.doc_id: r.text for r in substrings.deduplicate(table(spark, texts)).collect()}
    assert [i for i, t in enumerate(kept) if found[i].split() != t.split()] == []


def test_chunks_resist_insertions():
    import numpy as np

    rng = random.Random(1)
    text = prose(rng, 500)

    def cut(t):
        ends = [0, *substrings.chunk_ends(np.frombuffer(t.encode(), dtype=np.uint8)).tolist()]
        return [t[a:b] for a, b in zip(ends, ends[1:])]

    assert "".join(cut(text)) == text
    assert len(set(cut(text)) - set(cut("zzz " + text))) <= 2


# byte-pair encoding

SAMPLES = ["", "it's DON'T 12ab!! x,.y", "a\x1cb c", "ΣΑΣ Σ", "é ß İstanbul ﬁ ½ 中文", "<|endoftext|> z<|startoftext|>q", "x" * 300, "ab,.! c.!,d word's,. ... !!!", "the thnd thingor, rely. " * 30]


def test_bpe_equals_the_library(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    docs = table(spark, [*SAMPLES, None])
    lexicon = bpe.lexicon_for(path, bpe.frequent_words(docs, path))
    found = {r.doc_id: r for r in bpe.digests(docs, path, lexicon).collect()}
    ids = {r.doc_id: list(r.ids) for r in bpe.with_ids(docs, path, lexicon).collect()}
    for i, t in enumerate([*SAMPLES, None]):
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert ids[i] == want and found[i].n_tokens == len(want)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(odd, path, lexicon).count() == odd.count() and bpe.digests(none, path, lexicon).count() == 0


def test_lexicon_is_exact():
    words = {f"{a}{b}{c}".encode(): [len(a), 7, i] for i, (a, b, c) in enumerate(itertools.product(["un", "re", ""], ["do", "make", "x"], ["ing", "s", ""]))}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words.items()))
    asked = [*words, b"", b"undoin", b"zzz", b"doingx"]
    numbers = lexicon.numbers(asked)
    assert (numbers[-4:] == -1).all() and lexicon.outputs(numbers[:-4]) == list(words.values())


def test_merging_many_equals_merging_one():
    vocabulary = bpe.vocabulary_at(bpe.tokenizer_path())
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorstéß") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)]
    assert bpe.merger_of(vocabulary).all(words) == [vocabulary.merge(w) for w in words]


class _Counted(bpe.AsIds):
    """Counts how often the ids of each word are made."""

    entries = 400

    def __init__(self):
        self.made = {}

    def word(self, ids):
        self.made[tuple(ids)] = self.made.get(tuple(ids), 0) + 1
        return tuple(ids)


def test_pieces_that_come_back_are_not_merged_again():
    """Words of every other text are merged once, although the memo fills up several times; what it holds stays bounded."""
    path, rng = bpe.tokenizer_path(), random.Random(9)
    vocabulary, render = bpe.vocabulary_at(path), _Counted()
    fresh = ["".join(rng.choice("bdfghklmnprst") + rng.choice("aeiou") for _ in range(5)) + "q" for _ in range(60 * 60)]
    often = ["x" + "".join(rng.choice("aeiou") + rng.choice("bdfgklmn") for _ in range(4)) + "z" for _ in range(20)]
    texts = [" ".join(fresh[60 * i : 60 * i + 60] + (often if i % 2 else [])) for i in range(60)]
    encoder = bpe.Encoder(vocabulary, bpe.Lexicon(bpe.lexicon_for(path)), render)
    found = list(encoder.batches(texts, chars=1))
    assert [[list(ids) for ids in values] for values in found] == [[vocabulary.merge(w.encode()) for w in t.split()] for t in texts]
    assert {render.made[tuple(vocabulary.merge(w.encode()))] for w in often} == {1}
    assert len(encoder.memo.now) + len(encoder.memo.before) <= 400 + 2 * 80
    assert len(encoder.known.now) + len(encoder.known.before) <= 100 + 2 * 80


def test_words_rendered_together_are_those_rendered_alone():
    sizes, ids = np.array([1, 3, 0, 2]), np.array([7, 8, 49_407, 1, 70_000, 2], dtype=np.int32)
    for render in (bpe.AsIds(), packing._Packed()):
        assert render.words(ids, sizes) == [render.word(x) for x in ([7], [8, 49_407, 1], [], [70_000, 2])]


# packing


def check_packing(rows, expected, window):
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    for key, total in expected.items():
        at = 0
        for start, length in sorted((r.start, r.length) for r in rows if r.doc_id == key):
            assert start == at
            at += length
        assert at == total
    assert sorted(placed) == list(range(len(placed)))
    return len(placed)


def test_packing(spark, none):
    rng = random.Random(4)
    texts = [prose(rng, int(rng.paretovariate(0.8) * 20) % 3000) for _ in range(120)] + [None, ""]
    docs = table(spark, texts)
    path = bpe.tokenizer_path()
    ids = {r.doc_id: [*r.ids, 1] for r in bpe.with_ids(docs, path, bpe.lexicon_for(path)).collect()}
    rows = packing.pack_documents(docs, path, 256).collect()
    n = check_packing(rows, {k: len(v) for k, v in ids.items()}, 256)
    assert n <= -(-sum(map(len, ids.values())) // 256) * 1.02 + 1
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.doc_id][r.start : r.start + r.length]))
    assert packing.pack_documents(none, path, 256).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        capacity = rng.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        taken = packing.fullest(counts, capacity)
        assert all(taken[k] <= counts[k] for k in taken)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= capacity)


# n-gram Jaccard join


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [(len(sets[i]), find(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, size, percent):
    rng = random.Random(size)
    texts = [None, "", "one", "ONE", "one two", "one two three four", "one two three four five"]
    for _ in range(25):
        base = prose(rng, rng.choice([6, 12, 30, 80, 200])).split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            now = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                now[rng.randrange(len(now))] = rng.choice(WORDS)
            texts.append(" ".join(now))
    passage = prose(rng, 40)
    texts += [f"{passage} {prose(rng, 30)}" for _ in range(30)]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.with_components(table(spark, texts), size=size, percent=percent).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(texts, size, percent)


def test_lists_that_are_long(spark, monkeypatch):
    """Lists that are too long to be paired put their sets into one group; keys that stand twice in a set are two keys."""
    monkeypatch.setattr(jaccard, "PAIRED", 3)
    rng = random.Random(31)
    base, texts = [prose(rng, 60).split() for _ in range(3)], []
    for i in range(90):
        now = list(base[i % 3])
        for _ in range(rng.choice([0, 1, 2, 3])):
            now[rng.randrange(60)] = rng.choice(WORDS)
        texts.append(" ".join(now))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.with_components(table(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(texts, 4, 85)
    import numpy as np

    keys = jaccard.instances(np.array([3, 3, 5, 9, 9, 9], dtype=np.uint32)).tolist()
    assert len(set(keys)) == 6 and [k % 2**32 for k in keys] == [3, 3, 5, 9, 9, 9] and [k >> 32 for k in keys] == [0, 1, 0, 0, 1, 2]


def test_jaccard_of_odd_rows(spark, odd, none):
    found = jaccard.with_components(odd)
    assert found.count() == odd.count() and jaccard.with_components(none).count() == 0
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(r.doc_id, r.doc_id) for r in odd.collect()}


def test_representatives(spark, odd, none):
    rng = random.Random(5)
    a, b = prose(rng, 50), prose(rng, 50)
    kept = jaccard.representatives(table(spark, [a, a + " more", b, a, None, ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]
    found = jaccard.representatives(odd)
    assert found.columns == odd.columns and found.count() == odd.count() - 1
    assert jaccard.representatives(none).count() == 0
