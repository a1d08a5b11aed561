import base64
import hashlib
import math

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from messy_rows import SF, docs, messy, none, odd  # noqa: F401  fixtures
from tokenizers import Tokenizer

from traceweave.llm import byte_bpe, html_text, packing, substring_dedup, token_counts, transducer
from traceweave.llm import queries as q

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(JSON).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def sf_texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# HTML -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("only &lt;text&gt; ", "only <text>"),
        ("<script>if (a<b) x()</script>", ""),
        ("<nav><nav>x", ""),
        ("<body><p>a\n b&nbsp;c<p>d<br>e</body>", "a b c\nd e"),
        ("<body><article><h1>T</h1><p>one <b>bo</b>ld<p>two</article><footer>f</footer>", "T\none bold\ntwo"),
        ("<body><div class='ad-box'>buy</div><div><p>real text<ul><li>a<li>b</ul></div><div id=comments><p>nice", "real text\na\nb"),
        ("<body><div><p>x</p></div><!-- <p>y</p> --><form><p>z</form>", "x"),
        ("<body><section><p>long text here</section><section><p>more text here</section>", "long text here\nmore text here"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_dense_subtree_wins_over_link_lists():
    links = "".join(f"<li><a href=x>link number {i}</a>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>{'word ' * 40}</p><p>{'text ' * 40}</p></div></body>"
    assert html_text.main_text(page) == ("word " * 40).strip() + "\n" + ("text " * 40).strip()


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content no-sidebar'>{}</div>",
        "<div class='layout with-sidebar'>{}<div class=sidebar>see also</div></div>",
        "<div class='layout withSidebar'>{}</div>",
        "<div id=page class=has-header><div class=header>site name</div>{}<div class=comments><p>nice</div></div>",
        "<section id=legal>{}</section>",
        "<div class='post related-2024'>{}</div><div class=ad>buy</div>",
        "<div class='post comments-open'>{}<div class=comment>one</div><div class=comment>two</div></div>",
        "<span class=promo>{}</span>",
        "<article><p class=notice>note</p><div class='entry legal'>{}</div></article>",
        # Reader comments above the article's length, one by one and beside an article element.
        "<div>{}</div><div class=comments>" + "<div class=comment><p>agreed, says a reader of it</div>" * 9 + "</div>",
        "<article>{}</article><div class=comments>" + "<p>agreed, says a reader of it" * 9 + "</div>",
        "<main><article>{}</article><div class=comments>" + "<p>agreed, says a reader of it" * 9 + "</div></main>",
        # All with a hint; the largest stays.
        "<div class=sidebar>" + "side " * 10 + "</div><div class='post related'>{}</div><div class=widget>" + "more " * 10 + "</div>",
    ],
)
def test_words_of_class_and_id_are_hints_only(page):
    page = "<body>" + page.replace("{}", f"<p>{'word ' * 10}</p><p>{'text ' * 10}</p>") + "<footer>f</footer></body>"
    assert html_text.main_text(page) == ("word " * 10).strip() + "\n" + ("text " * 10).strip()


def test_small_elements_with_a_hint_go():
    page = "<body><div class=ad>buy</div><p>one <span class=share>tell</span> two<p class='ad has-image'>x</p><div class='ad'/><p>end</p></body>"
    assert html_text.main_text(page) == "one two\nend"
    nested = "<div class=ad>" * 3000 + "x" + "</div>" * 3000
    assert html_text.main_text(f"<body><p>real text here</p>{nested}</body>") == "real text here"


def test_pages_query(spark):
    out = q.QUERIES["op1_main_text"](spark, SF)
    found = rows(out)
    assert len(found) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 and "<" not in r["text"] for r in found)


def test_pages_with_nulls_and_clashes(spark):
    pages = spark.createDataFrame([(1, "u", None, "z"), (None, None, "<p>a", "z")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in rows(html_text.extract_text(pages))) == [("", 0), ("a", 1)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# Substring dedup ------------------------------------------------------------------------------------------------


def check_kept(found, texts):
    want = brute.kept_words(texts)
    assert len(found) == len(want)
    for r in found:
        words, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words), len(words) - len(kept), sha(" ".join(kept)))


def test_substring_query_equals_brute_force(spark):
    check_kept(rows(q.QUERIES["op2_substring_dedup"](spark, SF)), sf_texts(spark))


def test_substring_on_messy_rows(docs):
    out = substring_dedup.remove_factors(docs, substring_dedup.duplicate_factors(docs), show=("kept_text", "factors"))
    found = rows(out)
    check_kept(found, [(r[0], r[1]) for r in messy()])
    assert all(f["words"] >= 13 for r in found for f in r["factors"])
    assert all(r["kept_sha256"] == sha(r["kept_text"]) for r in found)


def test_substring_keeps_columns_and_untouched_texts(docs):
    out = substring_dedup.without_factors(docs, substring_dedup.duplicate_factors(docs))
    assert out.columns == docs.columns
    want = brute.kept_words([(r[0], r[1]) for r in messy()])
    before = {r[0]: r for r in messy()}
    for r in out.collect():
        words, kept = want[r["doc_id"]]
        assert r["text"] == (before[r["doc_id"]][1] if kept == words else " ".join(kept))
        assert tuple(r)[2:] == before[r["doc_id"]][2:]


def test_substring_odd_ids(odd, none):
    found = rows(substring_dedup.remove_factors(odd, substring_dedup.duplicate_factors(odd), show=()))
    removed = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in found)
    assert removed == [(0, 0, 0), (0, 40, 0), (7, 2, 0), (7, 40, 0), (7, 40, 0), (8, 0, 0), (9, 40, 40)]
    assert substring_dedup.remove_factors(none, substring_dedup.duplicate_factors(none)).count() == 0


def test_substring_one_row_of_a_repeated_id_is_a_copy(spark):
    first, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    given = [(1, first), (5, first), (5, other), (9, "lead " + other)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = rows(substring_dedup.remove_factors(docs, substring_dedup.duplicate_factors(docs), show=("kept_text",)))
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in found) == [(1, 0, first), (5, 0, other), (5, 40, ""), (9, 40, "lead")]


# Tokens ---------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_pattern():
    r = np.random.default_rng(2)
    signs = list(" \n\t'strvmldeaX59.!é 漢 ́²")
    texts = ["".join(r.choice(signs, int(r.integers(0, 50)))) for _ in range(4000)] + ["a" * 500, " " * 500, None]
    pieces = transducer.pieces_of(pa.array(texts))
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, text in enumerate(texts):
        own = [pieces.distinct[c].decode() for c in pieces.code[pieces.first[i] : pieces.first[i + 1]]]
        assert own == pattern.findall(text or "")


def test_transducer_counts_and_forgetting(monkeypatch):
    ranks = transducer.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("theinrsaéß漢"), int(r.integers(1, 40)))) for _ in range(2000)] + ["ab" * 2000]
    want = [len(encoding.encode_ordinary(w)) for w in words]
    assert transducer.CountTransducer(ranks).counts([w.encode() for w in words]).tolist() == want
    monkeypatch.setattr(transducer, "MOST_STATES", 50)
    assert transducer.CountTransducer(ranks).counts([w.encode() for w in words]).tolist() == want


def test_token_counts(docs, odd, none):
    texts = {r[0]: r[1] for r in messy()}
    want = dict(zip(texts, library_ids(texts.values())))
    for r in rows(token_counts.token_counts(docs, RANKS, limit=20)):
        n = len(want[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 20)
    assert token_counts.token_counts(odd, RANKS).count() == 7
    assert token_counts.token_counts(none, RANKS).count() == 0


def test_token_count_query(spark):
    texts = dict(sf_texts(spark))
    want = dict(zip(texts, library_ids(texts.values())))
    found = rows(q.QUERIES["op3_token_counts"](spark, SF))
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {d: len(i) for d, i in want.items()}


def test_byte_bpe(docs, odd, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in messy()}
    found = rows(byte_bpe.encode_decode(docs, RANKS))
    assert len(found) == len(texts)
    for r in found:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]])
    assert byte_bpe.encode_decode(odd, RANKS).count() == 7
    assert byte_bpe.encode_decode(none, RANKS).count() == 0


def test_byte_bpe_query_round_trip(spark):
    texts = dict(sf_texts(spark))
    found = rows(q.QUERIES["op4_byte_bpe"](spark, SF))
    assert {r["doc_id"]: r["decoded_sha256"] for r in found} == {d: sha(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in found} == dict(zip(texts, map(len, library_ids(texts.values()))))


# Packing --------------------------------------------------------------------------------------------------------


def check_packing(found, texts, capacity):
    want = dict(zip(texts, library_ids(texts.values())))
    sequences = {}
    for doc in texts:
        ids, at = [*want[doc], 2], 0
        own = sorted((r for r in found if r["doc_id"] == doc), key=lambda r: r["piece"])
        for i, r in enumerate(own):
            assert (r["piece"], r["start"]) == (i, at)
            assert r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
            assert i == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids)
        assert len(own) == -(-len(ids) // capacity)
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = math.ceil(sum(r["length"] for r in found) / capacity)
    assert len(sequences) <= max(least * 1.05, least + 1)


def test_packing_query(spark):
    check_packing(rows(q.QUERIES["op9_best_fit_packing"](spark, SF)), dict(sf_texts(spark)), 1024)


def test_packing_messy(docs, odd, none):
    check_packing(rows(packing.packed(docs, JSON, capacity=64)), {r[0]: r[1] for r in messy()}, 64)
    assert packing.packed(odd, JSON).count() == 7
    assert packing.packed(none, JSON).count() == 0


def test_plan_places_every_piece_once():
    r = np.random.default_rng(1)
    counts = {int(x): int(r.integers(1, 40)) for x in r.choice(np.arange(1, 101), 60, replace=False)}
    slots = packing.plan(counts, 100)
    for length, n in counts.items():
        spans = sorted((a, b) for size, a, b, _, _ in slots if size == length)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    used = {}
    for length, a, b, first, offset in slots:
        for i in range(b - a):
            used.setdefault(first + i, []).append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    # As many sequences as best fit decreasing needs piece by piece.
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [x for x in rooms if x >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 100) - length)
    assert len(used) == len(rooms)


def test_pieces_are_encoded_as_by_the_library(monkeypatch):
    """Rank merging and the library agree piece by piece; both ways of `encoder` are used."""
    fast, added = packing.encoder(JSON)
    monkeypatch.setattr(packing, "_byte_signs", dict)
    library, same = packing.encoder(JSON)
    assert added == same and fast.__name__ != library.__name__
    pieces = [b" the", b"ab" * 50, "日本".encode(), b" ", b"\n\n", b"'s", b"12345", b"!?#", " éß".encode()]
    pieces += [p for t in messy() for p in transducer.pieces_of(pa.array([t[1]], pa.string())).distinct]
    assert fast(pieces) == library(pieces)
