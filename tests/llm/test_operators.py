"""Corpus operators against brute force, on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries as Q
from plumbline.llm.bpe import WordEncoder, encode_decode, load_tokenizer
from plumbline.llm.chat_format import format_conversations, parse_conversations
from plumbline.llm.common import scratch_dir
from plumbline.llm.decontaminate import _PLAIN, contaminated, drop_contaminated
from plumbline.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from plumbline.llm.html_extract import extract_main_text, main_text
from plumbline.llm.license_scan import BASE, NAMING, TEMPLATES, license_scan
from plumbline.llm.near_dedup import bands_for, drop_near_duplicates, near_duplicates, sketch
from plumbline.llm.quality_qda import keep_good, quality_scores
from plumbline.llm.substring_dedup import substring_dedup
from plumbline.llm.textkit import mix64, rolling, sliding_min
from plumbline.llm.token_store import read_tokens, write_tokens

SCHEMA = "doc_id long, text string, block int, h long, n long, pack string, rep long, _w array<string>"  # names that operators use inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, ["y"]) for i, t in rows], SCHEMA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "ün", "sé", "no"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = prose(1, 200)
    words = base.split()
    near = " ".join(words[:90] + ["changed"] + words[91:])
    rows = [(10, base), (3, base), (7, base.upper()), (12, near), (20, prose(2, 80)), (21, prose(3, 60) + " " + " ".join(words[20:120]) + " " + prose(4, 30)), (5, None), (6, ""), (8, "one"), (9, "one"), (11, "One two"), (None, base), (20, prose(2, 80)), (30, prose(5, 6000)), (31, "x" * 50_000), (32, " \n\t "), (33, "a  b <|endoftext|> c\n d "), (34, "é b c​d 's don't 12  ab 😀"), (35, " lead and trail ")]
    return rows


@pytest.fixture(scope="module")
def path():
    return Q.tokenizer_path()


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


EMPTY: list = []


def test_exact_dedup(spark, corpus):
    got = sorted(map(tuple, exact_dedup(frame(spark, corpus)).collect()), key=repr)
    want = []
    for i, t in corpus:
        ids = [j for j, u in corpus if low(u) == low(t)]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup(frame(spark, EMPTY)).count() == 0
    kept = drop_exact_duplicates(frame(spark, corpus))
    assert kept.columns == frame(spark, EMPTY).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[3]), key=repr)


def test_pipeline_keeps_one_of_rows_loaded_many_times(spark, corpus):
    import corpus_pipeline as P

    rows = [*corpus, *[(50, prose(6, 40))] * 3, (49, prose(6, 40).upper()), (50, prose(8, 40)), (None, "lost"), (None, "lost")]
    out = dict(P.STAGES)["exact_dedup"](spark, frame(spark, rows), "")
    assert out.columns == frame(spark, EMPTY).columns
    texts = {low(t) for _, t in rows}
    want = [(max((j for j, u in rows if low(u) == t and j is not None), default=None), t) for t in texts]
    assert sorted(((r.doc_id, low(r.text)) for r in out.collect()), key=repr) == sorted(want, key=repr)


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [low(x) for x in words_of(t)]
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a is not None and b is not None and a != b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (i, len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("k,share", [(3, (85, 100)), (5, (80, 100))])
def test_near_dedup(spark, corpus, k, share):
    words = prose(9, 120).split()
    rng = random.Random(4)
    chain = []
    for n in range(30):  # a chain of edits and a group of copies around one text
        edited = words.copy()
        edited[rng.randrange(120)] = f"edit{n}"
        if n % 3 == 0:
            words = edited
        chain.append((1000 + rng.randrange(10**6), " ".join(edited)))
    rows = [*corpus, *chain]
    got = sorted(map(tuple, near_duplicates(frame(spark, rows), shingle_words=k, similarity=share).collect()), key=repr)
    want = brute_components(rows, k, *share)
    assert got == sorted((want[i] for i, _ in rows), key=repr)
    assert near_duplicates(frame(spark, EMPTY), shingle_words=k).count() == 0
    kept = drop_near_duplicates(frame(spark, rows), shingle_words=k, similarity=share)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if want[i][3]), key=repr)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 5000):
        assert (sketch(rng.integers(1, 2**63, n, dtype=np.uint64), 100) < np.iinfo(np.uint64).max).all()
    a = rng.integers(1, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(1, 2**63, 100, dtype=np.uint64)])
    assert abs((sketch(a, 512) == sketch(b, 512)).mean() - 0.8) < 0.08
    assert (1 - 0.85**5) ** bands_for(0.85) < 1e-6


def test_rolling_hash_and_sliding_minimum():
    w = mix64(np.arange(50, dtype=np.uint64))
    r = rolling(np.concatenate([w, w]), 12)
    np.testing.assert_array_equal(r[:39], r[50:89])
    assert len(np.unique(r[:50])) == 50
    x = np.random.default_rng(0).integers(0, 1000, 100).astype(np.uint64)
    for k in (1, 2, 5, 39):
        np.testing.assert_array_equal(sliding_min(x, k), np.lib.stride_tricks.sliding_window_view(x, k).min(1))


def test_substring_dedup(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup(frame(spark, rows), shard_bytes=4000).collect()}
    owner: dict = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words_of(t)
        for p in range(len(w) - 49):
            owner.setdefault(tuple(w[p : p + 50]), i)
    want = set()
    for i, t in rows:
        w = words_of(t)
        lost = {q for p in range(len(w) - 49) if owner[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        kept = " ".join(x for q, x in enumerate(w) if q not in lost)
        want.add((i, len(w), len(lost), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert got == want
    assert any(0 < r[2] < r[1] for r in got)
    assert substring_dedup(frame(spark, EMPTY)).count() == 0
    assert substring_dedup(frame(spark, [(None, prose(1, 60)), (1, prose(1, 60))])).agg(F.sum("n_removed")).first()[0] == 0


def test_word_encoder_equals_library(path):
    enc, tok = WordEncoder(path, most=50), load_tokenizer(path)
    rng = random.Random(0)
    letters = ["a", "B", "é", "ß", "1", "²", "'s", "'ll", ".", ",", "…", "’", " ", "  ", "\n", "\t", " ", "​", "　", "\x1c", "\x85", "漢", "😀", "́", "ª", "<|endoftext|>", "­", "´"]
    for _ in range(3000):
        t = "".join(rng.choices(letters, k=rng.randint(0, 12)))
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_texts_encoded_together_equal_library(path):
    enc, tok, made = WordEncoder(path, most=50), load_tokenizer(path), []
    rng = random.Random(1)
    letters = ["a", "B", "é", "1", "'s", ".", "…", " ", " ", " ", "  ", "\n", "\t", "漢", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(2000)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1, 60, 1 << 20):
        assert [x.tolist() for x in enc.encode_many(texts, most)] == want
    assert list(enc.encode_many([])) == [] and [x.tolist() for x in enc.encode_many(["", "a  b"])] == [[], tok.encode("a  b").ids]
    enc.words = type(enc.words)(lambda w: made.append(w) or enc._word(w), 2)  # a word is looked up once, however little is remembered
    list(enc.encode_many([prose(1, 300)] * 3))
    assert len(made) == len(set(made))


def test_bpe_round_trip(spark, corpus, path):
    tok = load_tokenizer(path)
    got = sorted(map(tuple, encode_decode(frame(spark, corpus), path).collect()), key=repr)
    want = []
    for i, t in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        csv, text = ",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), csv, text, hashlib.sha256(csv.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert text == (t or "")
    assert got == sorted(want, key=repr)
    assert encode_decode(frame(spark, EMPTY), path).count() == 0


def test_token_store(spark, corpus, path):
    tok, where = load_tokenizer(path), scratch_dir(spark)
    shards = write_tokens(frame(spark, corpus), where, path, block_ids=512)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in read_tokens(spark, where, shards, with_ids=True).collect()]
    want, start = [], 0
    for i, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = write_tokens(frame(spark, EMPTY), scratch_dir(spark), path)
    assert empty.count() == 0
    assert read_tokens(spark, where, empty).count() == 0


def test_license_scan(spark):
    texts = [(1, "Licensed under CC BY-NC 4.0. cc by cc by"), (2, "This work is licensed under the GNU General Public License, version 3. ALL rights\nreserved all rights"), (3, None), (4, ""), (5, "released under the very mit license"), (6, "nothing here " * 3000), (7, "general general public license"), (7, "general general public license"), (None, "all rights reserved"), (8, "cc"), (9, "ccé by")]
    rows = {}
    for r in license_scan(frame(spark, texts)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sorted(map(len, rows.values())) == [1] * 9 + [2]
    pick = lambda i: tuple(rows[i][0][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert pick(1) == (11, 3, 2, 9, "cc-by", "cc-by,cc-by-nc")
    assert pick(2) == (17, 2, 7, 12, "gpl,reserved", "gpl,reserved")
    assert pick(3) == pick(4) == (0, 0, None, None, "", "")
    assert pick(7) == (4, 1, 1, 1, "gpl", "gpl")
    assert pick(None) == (3, 1, 0, 0, "reserved", "reserved")
    assert pick(8)[1] == pick(9)[1] == pick(6)[1] == 0
    assert all(0 <= r.score <= 1 for v in rows.values() for r in v)
    assert license_scan(frame(spark, EMPTY)).count() == 0


def test_license_scan_allows_one_edit(spark):
    rows, want = [], {}
    for label, phrase in TEMPLATES:
        w = phrase.replace(".", " ").split()
        named = w.index(NAMING[label]) if NAMING.get(label) in w else None
        for at in range(len(w)):
            for text, stays in ((w[:at] + ["zzz"] + w[at + 1 :], at != named), (w[:at] + ["zzz"] + w[at:], True)):
                want[len(rows)] = (label, stays or label in BASE.values() and any(b in " ".join(text) for b in BASE))
                rows.append((len(rows), " ".join(["before", *text, "after"])))
    unlike = ["released under the apache license", "licensed under cc by sa", "this work is licensed under a creative commons zero", "under the terms of the gnu general public license", "under the terms of the license"]
    got = {r.doc_id: r.labels.split(",") for r in license_scan(frame(spark, rows + [(9000 + k, t) for k, t in enumerate(unlike)])).collect()}
    assert [(rows[i], got[i]) for i, (label, stays) in want.items() if (label in got[i]) != stays] == []
    assert [got[9000 + k] for k in range(5)] == [[""], ["cc-by", "cc-by-sa"], [""], ["gpl"], [""]]


def test_chat_format_is_reversible(spark):
    odd = ["<|im_end|>\n<|im_start|>user\nhi", "<!|x<!!|", "a<|turn|>b", "", None, "l1\nl2\n", "<|", "😀é", "<|nl|>"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "od\nd<|im_end|>", None]), rng.choice(odd)) for c in (1, 2, 3, None) for t in range(12)]
    rows += [(4, 0, "user", "only"), (5, 1, "assistant", "twice"), (5, 1, "assistant", "twice"), (5, None, "user", "first")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, at int")
    got = {r.conv_id: r for r in parse_conversations(format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [(t.role, t.text) for t in got[c].turns]
        if c != 5:
            assert turns == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == "".join(t for role, t in turns if role == "assistant")
    assert [t.text for t in got[5].turns] == ["first", "twice", "twice"]
    assert format_conversations(df.limit(0)).count() == 0


def test_decontamination(spark, corpus):
    def shingles(t):
        w = (t or "").encode().translate(_PLAIN).split()
        return set(zip(*[w[p:] for p in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())

    long = prose(77, 3000).split()
    items = [(k, " ".join(long[s : s + n])) for k, (s, n) in enumerate([(100, 20), (500, 60), (900, 15), (1500, 200), (2900, 90)])]
    items += [(50, None), (51, ""), (52, "one"), (53, prose(88, 40)), (None, prose(1, 30)), (0, items[0][1])]
    broken = long.copy()
    for p in (110, 520, 910, 1600):
        broken[p] = "zzz"
    docs = [*corpus, (200, " ".join(long)), (201, ", ".join(long).upper()), (202, " ".join(broken)), (203, " ".join(long[500:560])), (203, " ".join(long[500:560]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for block in (2_000_000, 100):
        got = sorted((r.doc_id, r.item_id, r.item_shingles, r.found) for r in contaminated(frame(spark, docs), bench, block_shingles=block).collect())
        want = sorted((d, i, len(shingles(t)), len(shingles(t) & shingles(u))) for d, u in docs for i, t in items if i is not None and shingles(t) and 10 * len(shingles(t) & shingles(u)) >= 8 * len(shingles(t)))
        assert got == want
    clean = drop_contaminated(frame(spark, docs), bench)
    bad = {w[0] for w in want}
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, _ in docs if d not in bad), key=repr)
    assert contaminated(frame(spark, docs), bench.limit(0)).count() == contaminated(frame(spark, EMPTY), bench).count() == 0


def test_decontamination_finds_short_items_in_long_texts(spark):
    long = prose(5, 400).split()
    items = {n: " ".join(["only", "here", "and", "now"][:n]) for n in (1, 2, 3, 4)}
    docs = [(n, " ".join(long[:200] + [t.upper() + ","] + long[200:])) for n, t in items.items()]
    docs += [(9, " ".join(long)), (10, " ".join(long + ["now", "and", "here"])), (11, "only")]
    bench = spark.createDataFrame([*items.items(), (20, " ".join(long[50:80]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.item_shingles, r.found) for r in contaminated(frame(spark, docs), bench).collect()}
    assert {x for x in got if x[1] < 20} == {(d, i, 1, 1) for d in items for i in items if i <= d} | {(11, 1, 1, 1)}
    assert {x[0] for x in got if x[1] == 20} == {1, 2, 3, 4, 9, 10}
    assert {r.doc_id for r in drop_contaminated(frame(spark, docs), bench.where("item_id < 20")).collect()} == {9, 10}


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(r) > 40
    assert (r.predicted == r.quality).mean() > 0.95
    odd = frame(spark, [(1, None), (2, ""), (3, "x" * 100_000), (None, "a b"), (3, "again")])
    out = quality_scores(odd, labels).toPandas()
    assert len(out) == 5
    assert out.score.between(0, 1).all()
    assert quality_scores(frame(spark, EMPTY), labels).count() == 0
    assert set(quality_scores(odd, labels.limit(0)).toPandas().score) == {0.5}
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert 0.7 < kept.count() / docs.count() < 1


PAGES = {
    '<body><div class="header">Site</div><div class="content"><h1>T</h1><p>First para, with text and, commas, long enough to count here.</p><p>Second &amp; more text, again long enough, to count.</p><ul><li>one</li></ul></div><div class="sidebar"><p>Side text, long enough to be scored, maybe, yes.</p></div><div id="comments"><p>Reader comment, long enough to be scored.</p></div></body>': "T First para, with text and, commas, long enough to count here. Second & more text, again long enough, to count. one",
    "<article><p>Hello there, this is the text of the article.<div class='cookie-notice'><p>We use cookies, accept, please, now.</p></div><form><p>Name, please, and more text here</p></form><p>Goodbye, text\n\t of <b>the</b> article.<br>End</article><aside><p>aside, text, that is long enough</p></aside>": "Hello there, this is the text of the article. Goodbye, text of the article. End",
    "": "", "plain &lt;text&#33;": "plain <text!", "<p>short": "short", "<script>var a='<p>x</p>'</script>": "", "<!-- <p>no</p> --><div>a<b>b</b>c</div>": "abc", "<nav><ul><li>menu</ul></nav>": "",
}


def test_html_extraction(spark):
    for html, text in PAGES.items():
        assert main_text(html) == text
    assert main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    rows = [(k, f"u{k}", h, "t") for k, h in enumerate(PAGES)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(df).collect()}
    assert got == {k: (t, len(t)) for k, t in enumerate(PAGES.values())} | {None: ("", 0)}
    assert extract_main_text(df.limit(0)).count() == 0


ARTICLE = "The text of the article, which is long enough to be scored, with commas. " * 3
LOOSE = ["post format-standard hentry", "content no-sidebar", "main-content has-sidebar", "football", "footnotes", "commentary", "information", "headline", "noSidebar", "shareholders"]
AROUND = "<p>A short line of the page.</p>"


@pytest.mark.parametrize("name", LOOSE)
def test_html_names_match_in_whole_parts(name):
    assert main_text(f"<body><div class='{name}'><p>{ARTICLE}</p></div><div class='sidebar1'><p>Beside it.</p></div></body>") == ARTICLE.strip()
    assert ARTICLE.strip() in main_text(f"<body><div><p>{ARTICLE}</p><p id='{name}'>{ARTICLE}</p></div></body>").replace(ARTICLE, "", 1)


@pytest.mark.parametrize("name", ["social", "form", "site-header", "sidebar", "alert"])
def test_html_names_round_the_text_do_not_remove_it(name):
    assert ARTICLE.strip() in main_text(f"<body>{AROUND}<div class='{name}'><p>{ARTICLE}</p></div></body>")
    assert main_text(f"<body>{AROUND}<div class='{name}'><article><p>{ARTICLE}</p></article></div></body>") == ARTICLE.strip()
    assert main_text(f"<body>{AROUND}<div class='{name}'><main><p>{ARTICLE}</p></main></div></body>") == ARTICLE.strip()


def test_html_form_round_the_page_and_nothing_left():
    assert main_text(f"<body><form id='aspnetForm'><div class='menu'><p>Menu line</p></div><div><p>{ARTICLE}</p></div></form></body>") == ARTICLE.strip()
    assert main_text("<body><div class='comments'><p>All there is on this page.</p></div></body>") == "All there is on this page."


def test_html_comments_and_lists_of_other_articles_stay_out():
    other = "<article><p>Another text, with commas, of some length, as a card or from a reader.</p></article>"
    for name in ("comments", "related-posts", "recommended", "widget", "sideBar", "ad"):
        n = 20 if name in ("comments", "related-posts", "recommended") else 2
        assert main_text(f"<body><div class='post'><p>{ARTICLE}</p></div><div class='{name}'>{other * n}</div></body>") == ARTICLE.strip()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    from helpers import duck, rows

    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(duck(sf).sql(Q.ORACLE_SQL[name]).df())


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "bpe_tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    last: dict = {}
    for i, t in rows:
        last[low(t)] = max(i, last.get(low(t), -1))
    rows = [(i, t) for i, t in rows if last[low(t)] == i]
    comps = brute_components(rows, 5, 80, 100)
    rows = [(i, t) for i, t in rows if comps[i][3]]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def shingles(t):
        w = (t or "").encode().translate(_PLAIN).split()
        return set(zip(*[w[p:] for p in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(b) for b in bench]
    rows = [i for i, t in rows if not any(s and 10 * len(s & shingles(t)) >= 8 * len(s) for s in sets)]
    assert sorted(r.doc_id for r in P.run(spark, sf).collect()) == sorted(rows)


CLASHING = "doc_id long, text string, _drop_id long, _DROP_SHAS string, _drop_th long, _sha string, _label_id long, _len int, _head long, label int, x int, rep long, quality int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", 2, "b", 3, 4, 5, 6, 7, 8, 9) for i, t in rows], CLASHING)


def test_rows_that_repeat_an_id_with_another_text(spark):
    t, u = prose(51, 90), prose(52, 90)
    rows = [(1, t), (2, t), (2, u), (3, u + " end"), (4, t + " end"), (4, prose(53, 90)), (4, prose(53, 90)), (None, t), (5, None), (5, None), (6, " ")]
    got = sorted(map(tuple, near_duplicates(frame(spark, rows)).collect()), key=repr)
    n = lambda text: len(words_of(text)) - 4
    want = [(1, n(t), 1, True), (2, n(t), 1, False), (2, n(u), 2, True), (3, n(u) + 1, 2, False), (4, n(t) + 1, 1, False), *[(4, n(prose(53, 90)), 4, True)] * 2, (None, n(t), None, True), *[(5, 0, 5, True)] * 2, (6, 0, 6, True)]
    assert got == sorted(want, key=repr)
    kept = drop_near_duplicates(clashing(spark, rows))
    assert kept.columns == clashing(spark, EMPTY).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, t), (2, u), *[(4, prose(53, 90))] * 2, (None, t), (5, None), (5, None), (6, " ")], key=repr)
    three = drop_near_duplicates(frame(spark, [(1, t), (2, t), (2, u)]))
    assert sorted((r.doc_id, r.text) for r in three.collect()) == sorted([(1, t), (2, u)])


ODD = [(1, "Some text"), (2, "some TEXT"), (2, None), (3, ""), (3, None), (None, "some text"), (None, "lost"), (None, "lost"), (4, prose(54, 60)), (4, prose(54, 60)), (5, prose(54, 60) + " more"), (6, prose(55, 60_000)), (7, prose(55, 60_000))]


@pytest.mark.parametrize("stage", ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "bpe_tokens"])
def test_every_stage_takes_odd_rows(spark, sf, stage):
    """Nulls, empty, repeated and very long texts, empty tables and columns with the names that stages use inside."""
    import corpus_pipeline as P

    run = dict(P.STAGES)[stage]
    docs = clashing(spark, ODD)
    out = run(spark, docs, sf)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert run(spark, docs.limit(0), sf).count() == 0
    if stage == "bpe_tokens":
        assert sorted((r[0] for r in got), key=repr) == sorted((i for i, _ in ODD), key=repr)
        return
    assert out.columns == docs.columns
    pairs = [(r[0], r[1]) for r in got]
    assert all(r[2:] == (1, "a", 2, "b", 3, 4, 5, 6, 7, 8, 9) for r in got)
    if stage == "exact_dedup":
        want = [(2, "some TEXT"), (3, ""), (None, "lost"), (4, prose(54, 60)), (5, prose(54, 60) + " more"), (7, prose(55, 60_000))]
        assert sorted(((i, t or "") for i, t in pairs), key=repr) == sorted(want, key=repr)
    elif stage == "near_dedup":
        want = [r for r in ODD if r[0] not in (5, 7) and r != (2, "some TEXT")]
        assert pairs == sorted(want, key=repr)
    elif stage == "decontamination":
        assert pairs == sorted(ODD, key=repr)
    else:
        assert set(pairs) <= set(ODD)
        assert all(pairs.count(p) == ODD.count(p) for p in pairs)


def test_shuffle_joins_give_what_broadcasts_give(spark, corpus, monkeypatch):
    from plumbline.llm import common, quality_qda

    rows = [*corpus, *[(50, prose(6, 40))] * 3, (49, prose(6, 40).upper())]
    calls = (exact_dedup, drop_exact_duplicates, lambda d: drop_exact_duplicates(d, one_row=True), drop_near_duplicates)
    few = [sorted(map(str, f(frame(spark, rows)).collect())) for f in calls]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = keep_good(docs, labels).count()
    monkeypatch.setattr(common.sized, "__defaults__", (-1,))
    monkeypatch.setattr(quality_qda, "BROADCAST_ROWS", -1)
    assert [sorted(map(str, f(frame(spark, rows)).collect())) for f in calls] == few
    assert keep_good(docs, labels).count() == good


def test_full_hash_stands_above_the_refinement(spark, corpus):
    from plumbline.llm.exact_dedup import duplicate_groups

    plan = duplicate_groups(frame(spark, corpus))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [line for line in plan[next(k for k, line in enumerate(plan) if "LeftSemi" in line) + 1 :] if "sha2" in line]
    assert below == []


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    session = lambda master, base: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: base), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))
    assert scratch_dir(session("spark://host:7077", "hdfs://x/")).startswith("hdfs://x/plumbline/app-1/")
    for master in ("local", "local[4]", "local[*, 3]"):
        assert "/plumbline/app-1/" in scratch_dir(session(master, None))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_dir(session(master, None))


def test_substring_dedup_splits_hot_passages_and_requests(spark):
    shared, other = prose(61, 130).split(), prose(62, 70).split()
    rows = [(100 - k, " ".join(prose(700 + k, 30).split() + shared[k % 5 :] + prose(800 + k, 20).split() + (other if k % 3 else []))) for k in range(40)]
    rows += [(200, " ".join(["same"] * 400)), (201, " ".join(["same"] * 120)), (202, " ".join(["same", "again"] * 90)), (203, prose(63, 40_000)), (204, prose(63, 40_000)), (205, None)]
    run = lambda **o: sorted(map(tuple, substring_dedup(frame(spark, rows), shard_bytes=3000, with_text=False, **o).collect()))
    owner: dict = {}
    for i, t in sorted(rows):
        w = words_of(t)
        for p in range(len(w) - 49):
            owner.setdefault(hash(tuple(w[p : p + 50])), i)
    want = []
    for i, t in sorted(rows):
        w = words_of(t)
        lost = {q for p in range(len(w) - 49) if owner[hash(tuple(w[p : p + 50]))] < i for q in range(p, p + 50)}
        want.append((i, len(w), len(lost), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in lost).encode()).hexdigest()))
    assert sum(r[2] for r in want) > 40_000
    assert run() == want
    assert run(hot_packs=1, requests=50) == want


def test_substring_dedup_is_decided_by_words(monkeypatch):
    """Passages that hashes have chosen wrongly remove nothing; those of larger documents neither."""
    from plumbline.llm.substring_dedup import Pack, locate

    words = prose(64, 200).split()
    pack = Pack.build([5, 7, None], [" ".join(words[:120]).encode(), " ".join(words[60:]).encode(), " ".join(words).encode()])
    passage = " ".join(words[70:120]).encode()
    assert locate(pack, [(4, passage)], 50, 12).nonzero()[0].tolist() == [*range(70, 120), *range(120 + 10, 120 + 60)]
    assert locate(pack, [(5, passage)], 50, 12).nonzero()[0].tolist() == [*range(120 + 10, 120 + 60)]
    assert not locate(pack, [(9, passage)], 50, 12).any()
    broken = " ".join([*words[70:95], "other", *words[96:120]]).encode()
    assert not locate(pack, [(4, broken)], 50, 12).any()


def test_tokenizers_that_cannot_be_cut_are_used_whole(spark, corpus, path):
    import public_tokenizers

    from plumbline.llm.bpe import cuts_words

    other = public_tokenizers.path("word_bpe_49k.json")
    assert cuts_words(path) and not cuts_words(other)
    tok, enc = load_tokenizer(other), WordEncoder(other)
    rows = corpus[:12]
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in encode_decode(frame(spark, rows), other).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert enc.encode(t or "").tolist() == ids
        want.append((i, ",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)


def test_packs_with_missing_ids_raise(spark, path, tmp_path):
    import pyarrow as pa

    from plumbline.llm.bpe import _file, _restorer
    from plumbline.llm.common import bundle, write_once

    planes = lambda x: np.ascontiguousarray(np.array(x, "<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    write_once(str(tmp_path), _file(1), bundle([np.array([7], "<i8").tobytes(), bytes(1), np.array([2], "<i8").tobytes(), planes([0, 1])]))
    blob = bundle([planes([0]), planes([0, 1]), planes([11])])
    group = pa.table({"pack": pa.array([1]), "blob": pa.array([blob], pa.binary())})
    with pytest.raises(RuntimeError, match="lacks the ids"):
        _restorer(str(tmp_path), path, ["doc_id", "ids"])((pa.scalar(1),), group)


def test_packs_are_restored_in_bounded_parts(path, tmp_path):
    import pyarrow as pa

    from plumbline.llm import bpe
    from plumbline.llm.common import bundle, write_once

    texts = [prose(k, 300) for k in range(40)] + ["", prose(1, 3000) + " 😀"]
    words = sorted({w for t in texts for w in t.split(" ")})
    at, enc = {w: k for k, w in enumerate(words)}, WordEncoder(path)
    planes = lambda x: np.ascontiguousarray(np.array(x, "<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    lengths = [len(t.split(" ")) for t in texts]
    write_once(str(tmp_path), bpe._file(1), bundle([np.arange(len(texts)).astype("<i8").tobytes(), bytes(len(texts) - 1) + b"\1", np.array(lengths, "<i8").tobytes(), planes([at[w] for t in texts for w in t.split(" ")])]))
    ids = [x for w in words for x in (enc.ids(w) if w else b"", enc.ids(" " + w))]
    blob = bundle([planes([0] + [1] * (len(words) - 1)), planes([len(x) >> 2 for x in ids]), planes(np.frombuffer(b"".join(ids), "<i4"))])
    group = pa.table({"pack": pa.array([1]), "blob": pa.array([blob], pa.binary())})
    parts = list(bpe._restorer(str(tmp_path), path, ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"], 20_000)((pa.scalar(1),), group))
    assert len(parts) > 10 and all(p.num_rows == 1 or p.nbytes < 40_000 for p in parts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, (r, t) in enumerate(zip(pa.Table.from_batches(parts).to_pylist(), texts, strict=True)):
        got = load_tokenizer(path).encode(t, add_special_tokens=False).ids
        want = ",".join(map(str, got))
        assert r == {"doc_id": k if k < len(texts) - 1 else None, "n_tokens": len(got), "ids": want, "decoded": t, "ids_sha256": sha(want), "decoded_sha256": sha(t)}


def test_workers_forget_earlier_work_and_batches_are_bounded(spark, path):
    from plumbline.llm import bpe, common, textkit

    common.turn_to("near_dedup")
    textkit.word_hashes([b"one", b"two"])
    bpe.shared_encoder(path, 50)
    common.turn_to("near_dedup")
    assert len(textkit._hashes) == 2 and bpe.shared_encoder.cache_info().currsize == 1
    common.turn_to("bpe pack")
    assert not textkit._hashes and not bpe.shared_encoder.cache_info().currsize
    common.ship(spark)
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert [r.n for r in sizes.collect()] == [2000, 2000, 1000]


def brute_license(text):
    """The method in plain loops over one text: hits of k-grams, words that agree, merged diagonals, spans."""
    from plumbline.llm import license_scan as L

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    get = lambda x, k: x[k] if 0 <= k < len(x) else None
    labels, base_labels, n_base, first, last, score = set(), set(), 0, None, None, 0.0
    for label, phrase, base in [*((v, k, True) for k, v in BASE.items()), *((k, v, False) for k, v in TEMPLATES)]:
        v = phrase.replace(".", " ").split()
        k = 2 if base or len(v) < L.SHORT else L.KGRAM
        diagonals: dict = {}
        for p in range(len(w) - k + 1):
            for q in range(len(v) - k + 1):
                if w[p : p + k] == v[q : q + k]:
                    seen = diagonals.setdefault(p - q, set())
                    seen.update(range(q, q + k))
                    if not base and k == 2:
                        same = lambda a, b: get(w, p + a) is not None and get(w, p + a) == get(v, q + b)  # noqa: B023, E731
                        seen.update([q - 2] * same(-2, -2) + [q + 2] * (same(2, 2) or same(3, 2)) + [q + 3] * same(3, 3))
        whole = sorted(d for d, seen in diagonals.items() if base and len(seen) == len(v))
        if whole:
            base_labels.add(label)
            labels.add(label)
            n_base += len(whole)
            first, last = min(whole[0], first if first is not None else whole[0]), max(whole[-1], last if last is not None else whole[-1])
        islands: list = []
        for d in sorted(diagonals):
            if not islands or d - islands[-1][0] > L.SLACK:
                islands.append([d, set()])
            islands[-1][0] = d
            islands[-1][1] |= diagonals[d]
        for _, seen in islands:
            share = (len(seen) - 1) / (len(v) - 1) if base else len(seen) / len(v)
            score = max(score, share)
            naming = L.NAMING.get(label)
            if not base and share >= L.COVERAGE and (naming not in v or v.index(naming) in seen):
                labels.add(label)
    return len(w), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(score, 9)


def test_license_scan_equals_plain_loops(spark, sf, corpus):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(1_000_000 + (i or 0), t) for i, t in corpus]
    for n, (_, phrase) in enumerate(TEMPLATES):
        w = phrase.split()
        for k in range(4):
            own = [x for x in w if rng.random() > 0.04 * k]
            rows.append((2_000_000 + 10 * n + k, prose(n, 20) + " " + " ".join(own).upper() + ". " + prose(n + 50, 9) + " cc by, " + " ".join(w[:5])))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in license_scan(frame(spark, rows)).collect()}
    assert got == {i: brute_license(t) for i, t in rows}
    for i, t in rows:  # base places once more, without the method
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        assert got[i][1] == sum(words[p : p + len(b.split())] == b.split() for b in BASE for p in range(len(words)))
    whole = {label for label, _ in TEMPLATES}
    assert whole <= {x for v in got.values() for x in v[5].split(",")}


def test_chat_format_folds_long_conversations_in_parts(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"t{t}<|") for c, n in ((1, 1500), (2, 512), (3, 513), (4, 1)) for t in range(n)]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.collect():
        want, before = "", None
        for c, _, role, text in rows:
            if c == r.conv_id:
                want += ("" if before is None else "<|turn|>" if before == role else "<|im_end|>\n") + (f"<|im_start|>{role}\n" if before != role else "") + text.replace("<|", "<!|")
                before = role
        assert r.formatted == want + "<|im_end|>\n"
        raw = r.formatted.encode()
        assert [raw[s.start : s.start + s.size].decode() for s in r.loss_spans] == [t.replace("<|", "<!|") for c, _, role, t in rows if c == r.conv_id and role == "assistant"]


def test_html_attributes_as_browsers_read_them():
    for p in ("<p title=don't>", "<p title=\"don't\" data-x='\"'>", "<p title = don\"t class=>", "<p data-a='it' b=c's>", "<p a=\"never closed>", "<p x=y/>", "<p hidden-note=1 ' \">"):
        html = f"<body><div>{p}{ARTICLE}</p><p>{ARTICLE} It's more.</p></div></body>"
        assert main_text(html).endswith(f"{ARTICLE.strip()} It's more."), p
        assert main_text(html).startswith(ARTICLE.strip()), p


def test_html_classes_that_only_contain_a_word():
    for name in ("content overflow-hidden", "post type-post format-standard", "overflow-hidden", "x-hidden-y"):
        assert main_text(f"<body><div class='{name}'><p>{ARTICLE}</p></div></body>") == ARTICLE.strip()
        assert main_text(f"<body><div><p>{ARTICLE}</p><p>{ARTICLE}</p><div class='{name}'><p>A short part.</p></div></div></body>").endswith("A short part.")
    for name in ("hidden", "sr-only", "d-none box"):
        assert "Unseen" not in main_text(f"<body><div><p>{ARTICLE}</p><div class='{name}'><p>Unseen words of the page.</p></div></div></body>")


def test_html_keeps_all_siblings_of_the_best_container():
    small = "<h3>Head</h3><blockquote>Said.</blockquote><ul><li>one</li><li>two</li></ul><p>Short.</p><table><tr><td>cell</td></tr></table>loose <b>text</b><pre>x = 1</pre>"
    want = "Head Said. one two Short. cell loose text x = 1"
    body = f"<div id='c'><div class='part'><p>{ARTICLE * 4}</p><p>{ARTICLE * 4}</p></div>{small}<div class='part'><p>End, of it.</p></div><div><a href='/x'>one link</a> <a>two</a></div></div>"
    assert main_text(f"<body><nav>menu</nav>{body}<footer>foot</footer></body>") == " ".join([ARTICLE.strip()] * 1 + [ARTICLE.strip()] * 7 + [want, "End, of it."])
    # parts in containers of one kind; a region at the top of the page that nothing marks as text
    rows = "".join(f"<div class='row'><div class='col'><p>{ARTICLE}</p><p>Part {k}.</p></div></div>" for k in range(2))
    got = main_text(f"<body><div>Site 2020</div><h1>Title</h1>{rows}</body>")
    assert [f"Part {k}." in got for k in range(2)] == [True, True]
    assert "Site 2020" not in got


def test_html_over_all_pages(spark, sf):
    """Every page against a reading of its article by regular expressions."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        inside = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", "", inside, flags=re.S)
        inside = re.sub(r"</?(?:p|h\d|br|ul|ol|li|div|table|tr|td)\b[^>]*>", " ", inside)
        want[r.page_id] = " ".join(unescape(re.sub(r"<[^>]*>", "", inside)).split())
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got == want
    assert len(got) == 250


def test_html_long_page_is_read_whole():
    many = "".join(f"<p>Paragraph {k}, of a long text, with commas and words.</p>" for k in range(20_000))
    text = main_text(f"<body><div>{many}</div></body>")
    assert text.startswith("Paragraph 0,") and text.endswith("Paragraph 19999, of a long text, with commas and words.")
    assert text.count("Paragraph") == 20_000


def test_quadratic_discriminant_by_definition(spark, sf):
    """Scores against class moments, shrinkage and log-densities written out with pandas."""
    from plumbline.llm.quality_qda import FEATURES, statistics

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    x = np.array([statistics(t.encode() if t else None) for t in docs.text])
    known = docs.assign(row=range(len(docs))).merge(labels, on="doc_id")
    known = known[[zlib.crc32(str(i).encode()) % 5 != 0 for i in known.doc_id]]
    own = [x[known[known.quality == k].row] for k in (0, 1)]
    scatter = [(len(o) - 1) * np.cov(o.T) for o in own]
    pooled = sum(scatter) / (sum(map(len, own)) - 2)
    log = []
    for k in (0, 1):
        c = 0.95 * scatter[k] / (len(own[k]) - 1) + 0.05 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-4 * np.eye(len(FEATURES))
        d = x - own[k].mean(0)
        log.append(np.log((len(own[k]) + 1) / (sum(map(len, own)) + 2)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    with np.errstate(over="ignore"):
        want = 1 / (1 + np.exp(log[0] - log[1]))
    got = quality_scores(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).toPandas().sort_values("doc_id")
    order = np.argsort(docs.doc_id.to_numpy())
    np.testing.assert_allclose(got.score, want[order], atol=1e-6)
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_near_duplicates_and_decontamination_miss_nothing(spark):
    """Recall and precision over all documents of a table: every link of a brute-force search, and no other."""
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, num, den in ((3, 85, 100), (5, 80, 100)):
        sets = {}
        for i, t in rows:
            w = words_of(low(t))
            sets[i] = {hash(tuple(w[p : p + k])) for p in range(len(w) - k + 1)} if len(w) >= k else ({hash(tuple(w))} if w else set())
        holders: dict = {}
        for i, s in sets.items():
            for h in s:
                holders.setdefault(h, []).append(i)
        label = {i: i for i in sets}

        def top(i):
            while label[i] != i:
                i = label[i]
            return i

        for a, s in sets.items():
            common: dict = {}
            for h in s:
                for b in holders[h]:
                    common[b] = common.get(b, 0) + 1
            for b, both in common.items():
                if b > a and den * both >= num * (len(s) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    label[y] = x
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle_words=k, similarity=(num, den)).collect()}
        assert got == {i: (len(s), top(i)) for i, s in sets.items()}

    def shingles(t):
        w = (t or "").encode().translate(_PLAIN).split()
        return set(zip(*[w[p:] for p in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())

    bench = spark.read.parquet(f"{at}/benchmark.parquet")
    items = [(r.item_id, shingles(r.text)) for r in bench.collect()]
    want = {(i, j) for i, t in rows for s in [shingles(t)] for j, own in items if own and 10 * len(own & s) >= 8 * len(own)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want
    assert want
