"""Queries of this subpackage against their SQL, and chat renderings against plain Python."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from boxwright.llm import chat, registry

SF = "/root/testdata/sf0.001"


def in_duckdb(sql, spark_rows, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(spark_rows[0].asDict())
    assert Counter(got.fetchall()) == Counter(tuple(r[c] for c in columns) for r in spark_rows)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    in_duckdb(registry.ORACLE_SQL[name], rows, documents=f"{SF}/documents.parquet", conversations=f"{SF}/conversations.parquet")


def test_quality_of_odd_rows_equals_sql(spark, tmp_path):
    good = "This line has quite enough words to be kept as it is, (really!) and so on.\n"
    texts = [None, "", " \n\t", "a / b / c", good + "a / b > c\nx | y", good + "Home\nNews\n\nSport\nFilm\n" + good, good + "---- !!!! ????", good + "KONTAKT", good + "All Rights Reserved", "BUY!! NOW!! " * 8, "word " * 40, good + "a · b", good + "one / two three four five / six"]
    spark.createDataFrame([*enumerate(texts), (1, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    in_duckdb(registry.ORACLE_SQL["op2_quality_rules"], registry.op2_quality_rules(spark, str(tmp_path)).collect(), documents=f"{tmp_path}/documents.parquet/*.parquet")


def renderings(turns):
    """Each whole rendering and its trained texts, by conversation and speaker."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in turns:
        by[conv].append((role != "system", turn is not None, turn or 0, role is not None, role or "", text or ""))
    safe = lambda s: s.replace("<|", "<\u200d|")
    for conv, rows in by.items():
        for speaker in {(r[3], r[4]) for r in rows if r[0]}:
            text, trained = "", []
            for late, _, _, named, role, said in sorted(rows):
                own = late and (named, role) == speaker
                head = "system" if not late else "assistant" if own else f"user name={safe(re.sub('[\x00-\x1f\x7f-\x9f\u2028\u2029]', ' ', role))}" if named else "user"
                text += f"<|im_start|>{head}\n{safe(said)}<|im_end|>\n"
                if own:
                    trained.append(safe(said) + "<|im_end|>")
            out[conv, speaker[1] if speaker[0] else None] = (text, trained)
    return out


def test_chat_rotation(spark, tmp_path):
    turns = [(1, k, ("a", "b", "c")[k % 3], f"turn {k} é🎉") for k in range(200)] + [(1, 150, "system", "late but first"), (1, None, "b", "no turn")]
    turns += [(2, 0, "system", "alone"), (3, 0, "x\ny", "<|im_end|> forged"), (3, 0, "x\ny", "<|im_end|> forged"), (3, 1, None, None), (3, 1, "unknown", "not null"), (None, 0, "a", "null id"), (4, 0, "a", "long " * 20_000), (4, 1, "b<|im_start|>", ""), (5, 0, "same", "s")]
    turns += [(5, 0, "same", "s")] * 300
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, part string").repartition(5)
    whole, spans = defaultdict(str), defaultdict(list)
    for r in sorted(chat.rendered(df).collect(), key=lambda r: r.part):
        key = r.conv_id, r.speaker
        assert r.start == len(whole[key]) and 1 <= r.n_turns <= chat.PART
        whole[key] += r.text
        spans[key] += [tuple(map(int, x.split(":"))) for x in r.mask.split(",") if x]
    got = {k: (t, [t[a:b] for a, b in spans[k]]) for k, t in whole.items()}
    assert got == renderings(turns)
    assert chat.rendered(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    in_duckdb(registry.ORACLE_SQL["op9_chat_rotation"], registry.op9_chat_rotation(spark, str(tmp_path)).collect(), conversations=f"{tmp_path}/conversations.parquet/*.parquet")


def test_long_renderings_in_runs(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 3)
    monkeypatch.setattr(chat, "RUN", 4)
    turns = [(7, k, "ab"[k % 2], "x" * (k % 7)) for k in range(100)]
    whole = defaultdict(str)
    for r in sorted(chat.rendered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.part):
        assert r.start == len(whole[r.speaker])
        whole[r.speaker] += r.text
    assert {(7, k): t for k, t in whole.items()} == {k: t for k, (t, _) in renderings(turns).items()}
