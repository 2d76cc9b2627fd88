"""Every stage of the pipeline against brute force on its own input."""

import public_tokenizers
import regex
import sentencepiece
from test_corpus import expected_classes, leaked
from test_documents import WORD, measures

import corpus_pipeline
from boxwright.llm import pii, quality

SF = "/root/testdata/sf0.001"


BLANK = r"[ \t\n\x0b\f\r]"


def any_of(words):
    return "(" + "|".join(map(regex.escape, words)) + ")"


def failing(lines):
    """For each of lines, all with a word, whether the rules remove it."""
    n = [len(WORD.findall(x)) for x in lines]
    short = [k <= quality.ITEM_WORDS and not regex.search(rf'[.!?:;,…][\p{{Pe}}\p{{Pf}}"]*{BLANK}*$', x) for x, k in zip(lines, n, strict=True)]
    out = []
    for i, (x, k) in enumerate(zip(lines, n, strict=True)):
        low = high = i
        while low and short[low - 1]:
            low -= 1
        while high + 1 < len(lines) and short[high + 1]:
            high += 1
        count = lambda kind, x=x: len(regex.findall(kind, x))
        items = regex.split(rf"[|·•›»→]|(?<={BLANK})[/>](?={BLANK})", x)
        menu = len(items) >= quality.MENU_ITEMS and all(len(WORD.findall(y)) <= quality.ITEM_WORDS for y in items) or short[i] and high - low >= quality.MENU_ITEMS
        menu = menu or len(x) <= quality.MENU_CHARS and regex.fullmatch(any_of(quality.MENU_WORDS), x.strip(" \t\x0b\f\r"), regex.I) is not None
        marks = count(r"[\p{P}\p{S}]")
        noise = 3 * count(r"[#*$%&|<>]") >= k or marks >= quality.LEAST_MARKS and 2 * marks >= count(r"[\p{L}\p{N}]") or x.count("!") >= k and 2 * count(r"\p{Lu}") >= count(r"\p{L}")
        out.append(menu or noise or len(x) <= quality.PHRASE_CHARS and regex.search(any_of(quality.PHRASES), x, regex.I) is not None)
    return out


def good_part(text):
    """What the quality stage leaves of a text; None where it rejects it."""
    text = text or ""
    if measures(text)[-1]:
        return None
    chars = lambda s: sum(map(len, WORD.findall(s)))
    lines = text.split("\n")
    worded = [k for k, x in enumerate(lines) if WORD.search(x)]
    gone = {k for k, bad in zip(worded, failing([lines[k] for k in worded]), strict=True) if bad}
    kept = [x for k, x in enumerate(lines) if k not in gone]
    return "\n".join(kept) if 100 * sum(map(chars, kept)) >= quality.MIN_KEPT * chars(text) else None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "personal data", "pieces"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == names
        found = out.collect()
        assert len(found) == len({r.doc_id for r in found})
        got = {r.doc_id: r.text for r in found}
        assert k == 4 or all(r.n_chars == len(r.text) for r in found)
        if k == 0:
            want = {d: x for d, t in rows.items() if (x := good_part(t)) is not None}
        elif k == 1:
            want = {d: rows[d] for d in set(expected_classes(rows.items()).values())}
        elif k == 2:
            want = {d: t for d, t in rows.items() if not leaked(t, items)}
        elif k == 3:
            want = {d: pii.redacted(t) for d, t in rows.items()}
        else:
            want = rows
            assert all(list(r.piece_ids) == sp.encode(r.text or "") and r.piece_text == sp.decode(list(r.piece_ids)) for r in found)
        assert got == want
        rows, docs = got, spark.createDataFrame(found, out.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(rows)


def test_stages_of_odd_tables(spark):
    """Nulls in any column, repeated rows, a very long text, ties, clashing columns and no rows."""
    good = "This line has quite enough words to be kept as it is.\nAnd a second one follows here, with mail to a@b.cd in it."
    rows = [(1, good, "clash", None), (1, good, None, 2), (None, good + " more", "x", 3), (2, None, None, None), (3, "", "", 4), (4, " ".join(f"w{k}" for k in range(60_000)), "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, piece_ids long")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs.limit(0), docs):
            out = stage(spark, df, SF)
            assert k == 4 or out.columns == df.columns
            n = out.count()
        sizes.append(n)
    # short texts go; copies, rows without words and nulls stay apart or go by each stage's own rule
    assert sizes == [4, 4, 6, 6, 6]
