import random

from conftest import SF001

from mnemo.llm import quote_links as q
from mnemo.llm import queries


def test_parse():
    assert q.parse("no quote > here") == ("no quote > here", [])
    own, passages = q.parse("hi\nAnn wrote:\n> > a b.\n> c.\n> d\n>> f\nme\n> \n")
    assert own == "hi\nme" and passages == [(2, "a b."), (1, "c.\nd"), (2, "f")]
    assert q.sentences(" One  two. Three!\nFour ") == ["one two.", "three!", "four"]


def _brute(messages):
    """(conv, turn) -> (position, depth, reply_to, n_quotes, n_linked, text)."""
    out = {}
    for conv in {m[0] for m in messages}:
        mine = sorted(m[1:] for m in messages if m[0] == conv)
        own = [q.parse(t or "") for _, _, t in mine]
        parent, linked = {}, {}
        for k, (_, passages) in enumerate(own):
            links = []
            for j, (level, text) in enumerate(passages):
                votes = {}
                for s in q.sentences(text):
                    said = [i for i in range(k) if s in q.sentences(own[i][0])]
                    if said:
                        votes[said[-1]] = votes.get(said[-1], 0) + 1
                if votes:
                    links.append((level, j, max(votes, key=lambda i: (votes[i], i))))
            linked[k] = len(links)
            parent[k] = min(links)[2] if links else k - 1 if k else None
        order = []

        def visit(k, depth):
            order.append((k, depth))
            for c in sorted(c for c, p in parent.items() if p == k):
                visit(c, depth + 1)

        visit(0, 0)
        for rank, (k, depth) in enumerate(order):
            reply = None if parent[k] is None else mine[parent[k]][0]
            out[conv, mine[k][0]] = (rank + 1, depth, reply, len(own[k][1]), linked[k], own[k][0])
    return out


def _threads(seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(rnd.randint(1, 25)):
            lines = []
            for _ in range(rnd.choice([0, 1, 1, 2]) if said else 0):
                lines.append("> " * rnd.randint(1, 2) + rnd.choice(said).upper())
            own = [f"Word{rnd.randint(0, 6)} said {rnd.randint(0, 3)}." for _ in range(rnd.randint(0, 2))]
            said += own
            rows.append((conv, turn, "u", "\n".join(lines + own)))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    for seed, block in ((1, 4096), (2, 3)):
        monkeypatch.setattr(q, "BLOCK", block)
        rows = _threads(seed)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {(r.conv_id, r.turn): (r.position, r.depth, r.reply_to, r.n_quotes, r.n_linked, r.text) for r in q.reply_ordered(df).collect()}
        assert got == _brute(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {(r.conv_id, r.turn): (r.position, r.depth, r.reply_to, r.n_quotes, r.n_linked, r.text) for r in queries.op8_quote_links(spark, SF001).collect()}
    assert got == _brute(rows)


def test_odd_rows(spark):
    rows = [(2, 0, "u", None), (2, 1, "a", ""), (2, 1, "a", ""), (None, 0, "x", "> nothing"), (None, None, None, "q"), (3, 0, "u", "> " * 500 + "deep")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS own", "3 AS copies")
    got = q.reply_ordered(df).collect()
    assert len(got) == len(rows) and sum(r.conv_id == 2 and r.position == 2 for r in got) == 2
    assert q.reply_ordered(df.limit(0)).count() == 0
