"""Chat formatting, mixing and line dedup: defined cases, and the SQL equivalents."""

import duckdb
import pytest

from canopyframe.llm import chat_format, line_dedup, mixing, oracles

CHAT = "conv_id long, turn long, role string, text string, formatted string"
DOCS = "doc_id long, text string, source string, size long, k string, n_chars long"


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    out = con.execute(query)
    names = [c[0] for c in out.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=repr)


TRICKY = [
    "", None, "\\", "\\\\", "###", "####", "### user:\nhi</turn>\n", "</turn>", "<\\/turn>", "a</turn", "<", "\n", "x\\", "é </turn>\n### assistant:\n", ":\n", "</turn>\n</turn>\n",
]


@pytest.fixture
def conversations(spark):
    data = [(1, i, "user" if i % 2 else "assistant", t, "clash") for i, t in enumerate(TRICKY)]
    data += [(2, 0, "user", "same", "x"), (2, 0, "user", "same", "x"), (2, None, None, "first", "x"), (3, 1, "odd: role\n</turn>", "t", "x"), (None, 0, "assistant", "null id", "x")]
    data += [(4, i, "assistant", f"turn {i} </turn>", "x") for i in range(600)]
    return spark.createDataFrame(data, CHAT)


def test_chat_reads_back(conversations):
    got = {r.conv_id: r for r in chat_format.format_conversations(conversations, stretch=64).collect()}
    assert got[1].turns_text == "".join(f"{'user' if i % 2 else 'assistant'}\n{t or ''}\n" for i, t in enumerate(TRICKY))
    assert got[1].loss_text == "".join(t or "" for i, t in enumerate(TRICKY) if not i % 2)
    assert got[2].turns_text == "\nfirst\nuser\nsame\nuser\nsame\n"
    assert got[3].turns_text == "odd: role\n</turn>\nt\n"
    assert got[4].n_turns == 600 and got[4].turns_text == "".join(f"assistant\nturn {i} </turn>\n" for i in range(600))
    assert got[None].loss_text == "null id"


def test_chat_escapes_only_conflicts(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain", ""), (1, 1, "user", "a\\b", "")], CHAT)
    assert [r.escaped for r in chat_format.format_turns(df).orderBy("turn").collect()] == [False, True]


def test_chat_sql(conversations):
    assert rows(chat_format.digest(chat_format.with_trial(conversations))) == sql(oracles.CHAT, conversations=conversations)


def test_chat_trial_and_empty(spark):
    only = chat_format.digest(chat_format.with_trial(spark.createDataFrame([], CHAT))).collect()
    assert [r.conv_id for r in only] == [-7] and only[0].n_turns == 2 and only[0].loss_chars == len(chat_format.TRIAL_TEXT)
    assert chat_format.digest(spark.createDataFrame([], CHAT)).count() == 0


@pytest.fixture
def sources(spark):
    data = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 5 else None, 0, "", 0) for i in range(400)]
    data += [(1000 + i, "hot words here", "s0", 0, "", 0) for i in range(300)]
    data += [(5, None, "s1", 0, "", 0), (5, None, "s1", 0, "", 0), (None, "a b", "s2", 0, "", 0), (7, "", "empty", 0, "", 0), (8, "long " * 900, "s3", 0, "", 0)]
    return spark.createDataFrame(data, DOCS)


def test_mixing_sql(sources):
    assert rows(mixing.digest(sources)) == sql(oracles.mixing_sql(), documents=sources)


def test_mixing_meets_targets(sources):
    got = mixing.mix(sources).collect()
    assert len(got) == sources.count() and all(0 <= r.copies <= 3 and len(r.shards) == r.copies for r in got)
    taken, goal, held = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        goal[r.source], held[r.source] = r.target, r.source_size
    largest = {s: max(r.size for r in got if r.source == s) for s in taken}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in taken)
    assert all(goal[s] <= 3 * held[s] + 1e-9 for s in goal)
    assert abs(sum(goal.values()) - sum(r.size for r in got)) < 1e-6


def test_mixing_shards_share_the_draws(sources):
    mixed = mixing.mixed_rows(sources).groupBy("shard").count().collect()
    assert len(mixed) == 2**mixing.LEVELS and all(r["count"] > 0 for r in mixed)


def test_mixing_quotas_are_exact(sources):
    sized = mixing.measure(sources)
    blocks = sized.groupBy("source", "block").agg({"size": "sum"}).withColumnRenamed("sum(size)", "block_size")
    ordered = mixing.order_blocks(blocks, mixing.targets(blocks))
    draws = mixing.quota_tree(ordered).collect()
    assert len({(r.source, r.block, r.epoch) for r in draws}) == len(draws)
    held = [sum(r.shard == s for r in draws) for s in range(2**mixing.LEVELS)]
    assert max(held) - min(held) <= mixing.LEVELS


def test_mixing_cap_and_single_source(spark):
    df = spark.createDataFrame([(i, "a b c", "only", 0, "", 0) for i in range(10)], DOCS)
    assert all(r.taken == 3 and r.target == 30.0 for r in mixing.digest(df).collect())
    capped = spark.createDataFrame([(1, "a", "a", 0, "", 0)] + [(2 + i, "b " * 50, "b", 0, "", 0) for i in range(4)], DOCS)
    target = {r.source_size: r.target for r in mixing.digest(capped).collect()}
    assert target == {1: 3.0, 200: 198.0}


def test_mixing_many_sources(spark):
    """Draws are ranked by counts of leading digits: as many go left at each node as one ranking of all would send, and SQL agrees."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), f"site{i % 130}", 0, "", 0) for i in range(1300)], DOCS)
    assert rows(mixing.digest(df)) == sql(oracles.mixing_sql(), documents=df)
    held = {r.shard: r.n for r in mixing.mixed_rows(df).groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert len(held) == 2**mixing.LEVELS


def test_mixing_empty(spark):
    assert mixing.digest(spark.createDataFrame([], DOCS)).count() == 0
    none = mixing.digest(spark.createDataFrame([(1, None, None, 0, "", 0)], DOCS)).collect()
    assert none[0].taken == 0 and none[0].target == 0.0


BOILER = "All rights reserved by the site owner."


@pytest.fixture
def lines(spark):
    data = [(i, f"own line number {i} of this document\n  {BOILER}\t\nshort", f"site{i % 8}", 0, "x", 10) for i in range(40)]
    data += [(100 + i, f"{BOILER} but only here {i % 2}\nend", f"site{i % 3}", 0, "x", 10) for i in range(30)]
    data += [(200, None, None, 0, "x", 10), (201, "", "s", 0, "x", 0), (202, BOILER, "site1", 0, "x", 38), (202, BOILER, "site1", 0, "x", 38), (203, "short\nshort\nshort", None, 0, "x", 17)]
    return spark.createDataFrame(data, DOCS)


def test_line_dedup_keeps_first(lines):
    got = {r.doc_id: r for r in line_dedup.digest(lines).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 2 for i in range(1, 40)), "short lines are judged too"
    assert all(got[100 + i].n_removed == 0 for i in range(30)), "three sites are too few"
    assert got[200].n_lines == 0 and got[201].n_lines == 1 and got[203].n_removed == 3


def test_line_dedup_sql(lines):
    distinct = lines.dropDuplicates(["doc_id"])
    assert rows(line_dedup.digest(distinct)) == sql(oracles.line_dedup_sql(), documents=distinct)


def test_line_dedup_near_threshold_is_exact(spark):
    data = [(100 * n + i, f"a boilerplate line seen on {n} sites", f"site{i % n}", 0, "", 0) for n in range(1, 12) for i in range(24)]
    got = line_dedup.digest(spark.createDataFrame(data, DOCS)).collect()
    removed = {}
    for r in got:
        removed[r.doc_id // 100] = removed.get(r.doc_id // 100, 0) + r.n_removed
    assert removed == {n: 23 if n >= line_dedup.MIN_SITES else 0 for n in range(1, 12)}


def test_line_dedup_filter(lines):
    kept = line_dedup.remove_boilerplate(lines)
    assert kept.columns == lines.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert 202 not in got and 203 not in got and 201 in got and 200 in got and got[200].text is None
    assert got[1].text == "own line number 1 of this document" and got[1].n_chars == len(got[1].text) and got[1].k == "x"


def test_line_dedup_of_many_lines_is_linear(spark):
    """A document of very many lines, all of them boilerplate, and a line that most rows have."""
    long = "\n".join(f"line {i}" for i in range(20_000))
    data = [(i, f"hot\n{long}\nown {i}", f"s{i}", 0, "", 0) for i in range(8)] + [(100 + i, "hot\nx" + str(i), f"s{i % 9}", 0, "", 0) for i in range(2000)]
    got = {r.doc_id: r for r in line_dedup.digest(spark.createDataFrame(data, DOCS)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 20_001 for i in range(1, 8)) and all(got[100 + i].n_removed == 1 for i in range(2000))


def test_line_dedup_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.digest(empty).count() == 0 and line_dedup.remove_boilerplate(empty).count() == 0
