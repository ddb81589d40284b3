import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixelloom.llm import token_binary, token_count
from pixelloom.llm.html_extract import Page, extract_text, main_text, path_scores
from pixelloom.llm.token_binary import EliasFano, pack, read_shards, unpack, write_shards
from pixelloom.llm.token_count import token_counts
from pixelloom.llm.toxicity import LabelModel, held_out, toxicity

ODD = ["", None, " ", "\n", "a  b", " lead", "trail ", "x\n\ny", "tab\tz", "don't we'll 123 a1b2", "Hello<|endoftext|>World", "a  <|endoftext|> b", "<|startoftext|>x", "日本語 テキスト", "a\x85b\xa0c", "\x1cab\x1d", "ΑΣ İ É é", "word,", "!!!???", "a" * 3000, "ab" * 2000, "🎉👨‍👩‍👧 नमस्ते", "x . y ; z", "it's, 'S 'LL"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "null key", ""), (3, ODD[3], "")], "doc_id long, text string, n_tokens string")


def test_counts_are_the_librarys(spark, docs, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in token_counts(docs, path, limit=100).collect():
        t = "null key" if r.doc_id is None else ODD[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100), t[:20]


def test_counter_forgets_between_batches_only(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_count.TokenCounter(path)
    for batch in (["one two", "two"], ["two three four"], ["five six one", ""], ["one two three"]):
        assert counter.count(batch) == [len(library.encode(t, add_special_tokens=False).ids) for t in batch]
        assert len(counter.known) <= 3 + len({c for t in batch for c in t.split()})


def test_counts_of_every_letter():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_count.TokenCounter(path)
    r, letters = random.Random(7), [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(x) for x in zip(letters, r.sample(letters, len(letters)))] + ["".join(r.choices(letters, k=4)) for _ in range(20_000)]
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    got = counter.count(texts)
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


@pytest.mark.parametrize("shard", [2_000_000, 5])
def test_binary_round_trip(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(token_binary, "SHARD_IDS", shard)
    monkeypatch.setattr(token_binary, "CACHE", 30)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in read_shards(write_shards(docs.repartition(3), path)).collect())
    at = 0
    for (known, k), start, n, crc in rows:
        ids = [*library.encode((ODD[k] or "") if known else "null key", add_special_tokens=False).ids, 0]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert len(rows) == docs.count()
    assert read_shards(write_shards(docs.limit(0), path)).collect() == []


@pytest.mark.parametrize("sizes", [[], [0], [1], [0, 0, 5, 0], [70000, 1, 2], list(range(3000))])
def test_elias_fano(sizes):
    begins = np.r_[0, np.cumsum(np.array(sizes, dtype=np.int64))]
    ef = EliasFano.of(begins)
    assert ef.all().tolist() == begins.tolist()
    assert [ef.select(k) for k in range(len(begins))] == begins.tolist()
    if len(sizes) == 3000:
        assert 8 * (ef.low.nbytes + ef.high.nbytes) < 15 * len(begins)
    back, ids = unpack(pack(bytes(2 * int(begins[-1])), 2, begins))
    assert len(ids) == begins[-1] and back.all().tolist() == begins.tolist()


PAGES = [
    (None, ""),
    ("", ""),
    ("plain words only, no tags.", "plain words only, no tags."),
    ("<nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>One,  two.\n three.<p><b>Four<br><p>Five.</article><footer>&copy; us</footer>", "T & U\nOne, two. three.\nFour\nFive."),
    ("<header>Site</header><main><h2>Head</h2><p>Body text, long enough to count.</p><ul><li>item one<li>item two</ul><aside>Buy now, please.</aside></main><div class='sidebar'>Links, more.</div>", "Head\nBody text, long enough to count.\nitem one\nitem two"),
    ("<article><p>Read this, it is the text.</p><section id='comments'><p>Nice post, thanks. Really, great.</p></section><form>Mail <input></form></article><script>var t='</p>';</script><div class='cookie-notice'>We use cookies, sorry.</div>", "Read this, it is the text."),
    ("<body><div><p>No article tag here, but a long paragraph of text.</p><p>And another one, which is long too.</p></div><div class=ad>Buy it, now.</div><ul><li><a href=x>menu</a></li></ul>", "No article tag here, but a long paragraph of text.\nAnd another one, which is long too."),
    ("<article><p>One, two <img src=x> three. <button>Buy</button> Four <svg><path/></svg>five.</p></article>", "One, two three. Four five."),
    ("<div class='content has-sidebar'><p>The article stands in here, all of it.</p></div><div class='ad-box'>Buy, now.</div><footer>End.</footer>", "The article stands in here, all of it."),
    ("<article><p>First line,<br>second line.</p></article>", "First line,\nsecond line."),
    ("<article><p>cut in an entity &am", "cut in an entity &am"),
    ("<article><p>cut in a tag, yes.<p cla", "cut in a tag, yes."),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert main_text(html) == want


PROSE = "A long paragraph of the article, with commas, and with enough words to count; it goes on for a while."


def test_ratios_decide_inside_an_article():
    links = "".join(f"<li><a href='/{i}'>Another story {i}</a></li>" for i in range(6))
    page = f"<article><h1>Title</h1><p>{PROSE}</p><h2>Part</h2><p>{PROSE} <b>Bold</b> end.</p><p><a href='/x'>Short link</a></p><div class='zq'><div><div><h2>More stories</h2><ul>{links}</ul></div></div></div></article>"
    assert main_text(page) == f"Title\n{PROSE}\nPart\n{PROSE} Bold end.\nShort link"
    main = f"<main><article><h1>Title</h1>{f'<p>{PROSE}</p>' * 4}</article><div class='zq'><span>Deals</span><span>Shop</span></div></main>"
    assert main_text(main) == "Title\n" + "\n".join([PROSE] * 4)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<main><h1>Title</h1><p>Lead. {PROSE}</p><article>{f'<p>{PROSE}</p>' * 3}</article></main>", ["Title", f"Lead. {PROSE}", *[PROSE] * 3]),
        (f"<main><article>{f'<p>{PROSE}</p>' * 3}</article><article><h2>Second</h2><p>Other. {PROSE}</p></article></main>", [*[PROSE] * 3, "Second", f"Other. {PROSE}"]),
        (f"<body><article><p>First. {PROSE}</p></article><article>{f'<p>{PROSE}</p>' * 3}</article></body>", [f"First. {PROSE}", *[PROSE] * 3]),
        (f"<main><h1>Title</h1><article>{f'<p>{PROSE}</p>' * 3}</article><p>Last. {PROSE}</p></main>", ["Title", *[PROSE] * 3, f"Last. {PROSE}"]),
        (f"<body><div class='x'><p>Lead. {PROSE}</p></div><div class='y'>{f'<p>{PROSE}</p>' * 12}</div><div class='z'><p>Last. {PROSE}</p></div></body>", [f"Lead. {PROSE}", *[PROSE] * 12, f"Last. {PROSE}"]),
        (f"<body><p>Lead. {PROSE}</p><article>{f'<p>{PROSE}</p>' * 3}</article><ul><li><a href='/'>Home</a></li></ul></body>", [f"Lead. {PROSE}", *[PROSE] * 3]),
    ],
)
def test_chosen_text_stays_wherever_it_stands(page, want):
    assert main_text(page) == "\n".join(want)


def test_paths_are_smoothed_at_any_number():
    def page(n):
        return "<body><div>" + "".join(f"<p class='c{i}'>{PROSE if i % 2 else 'So it is'}</p>" for i in range(n)) + "</div></body>"

    for n in (20, 399, 401, 3000):
        assert main_text(page(n)).split("\n") == [PROSE if i % 2 else "So it is" for i in range(n)]


def test_path_scores_weigh_all_pairs():
    r = random.Random(5)
    for deep in (3, 9, 70):
        nodes = [(0, tuple(r.choices("xya", k=r.randrange(deep))), (), r.choice(["word", "One, two. Three!", "ab " * 30])) for _ in range(120)]
        sums = defaultdict(lambda: np.zeros(3))
        for _, path, _, text in nodes:
            bare = text.strip()
            share = 0.1 if "a" in path else 1.0
            sums[path] += [len(bare) * share, sum(c in ".,!" for c in bare) * share, 1]
        got = path_scores(nodes)
        assert set(got) == set(sums)
        for p in sums:
            total = np.zeros(3)
            for q, v in sums.items():
                same = next((i for i, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
                total += np.exp(-((len(p) + len(q) - 2 * same) ** 2) / 4.0) * v
            assert got[p] == pytest.approx(np.sqrt(total[0] / total[2] * (total[1] / total[2] + 0.1)), rel=1e-9)
    assert path_scores(Page("").nodes) == {}


def test_extract_table(spark):
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x, y.</p>", "")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(df).collect()}
    assert all(got[i] == (w, len(w)) for i, (_, w) in enumerate(PAGES)) and got[None][0] == "x, y."
    assert extract_text(df.limit(0)).collect() == []


def test_long_page_is_whole():
    page = "<article>" + "<p>word, next.</p>" * 20000 + "</article>"
    assert main_text(page).count("\n") == 19999


def test_label_model_finds_accuracies_and_dependence():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    votes = np.zeros((4000, 5), np.int64)
    for j, (hit, false) in enumerate([(0.6, 0.02), (0.5, 0.05), (0.4, 0.01)]):
        votes[:, j] = r.random(4000) < np.where(y, hit, false)
    votes[:, 3] = votes[:, 2]
    votes[:, 4] = np.where(r.random(4000) < 0.97, y, ~y) * 2 - 1
    model = LabelModel()
    post = model.fit(votes)
    assert ((post > 0.5) == y).mean() > 0.96
    assert any({2, 3} <= set(g) for g in model.groups)


def test_toxicity_on_rows_held_out(spark):
    r = random.Random(2)
    stem, rows, labels = ["grumblax", "snorfel", "idiot"], [], []
    for i in range(1500):
        words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(60)]
        toxic = i % 7 == 0
        for _ in range(4 if toxic else 0):
            words[r.randrange(60)] = r.choice(stem) + r.choice(["", "ig", "tum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "x")]
    labels += [(None, 1), (5001, None), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    hits = defaultdict(list)
    for x in out:
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        if x.doc_id is not None and x.doc_id < 1500 and x.held_out:
            hits[x.doc_id % 7 == 0].append(x.predicted)
    assert np.mean(hits[True]) > 0.95 and np.mean(hits[False]) < 0.01
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(x.predicted == 0 for x in toxicity(docs, none).collect())
    assert docs.select(held_out("doc_id")).count() == len(rows)


def test_encoder_forgets_newer_chunks(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, r = Tokenizer.from_file(path), random.Random(9)
    for most in (0, 1, 2, 3, 7, 40):
        monkeypatch.setattr(token_binary, "CACHE", most)
        encoder = token_binary.ChunkEncoder(path)
        for _ in range(30):
            texts = ["".join(r.choices(["a", "bb ", " c", "\n", " ", "it's ", "w%d " % r.randrange(50)], k=8)) for _ in range(4)]
            want = [np.array(library.encode(t, add_special_tokens=False).ids, f"<u{encoder.width}").tobytes() for t in texts]
            assert encoder.encode(texts) == want
