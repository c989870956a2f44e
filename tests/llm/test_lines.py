import hashlib
from collections import defaultdict

from siftline.llm import lines


def slow(rows, min_chars=40, min_docs=5):
    table = str.maketrans(lines.UPPER, lines.LOWER)
    key = lambda line: line.strip(lines.STRIPPED).translate(table)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_drop_lines_equals_brute_force(spark):
    long, other = "A line of text that is longer than forty characters", "Grüße: eine Zeile mit mehr als vierzig Zeichen, ja"
    rows = [(i, f"{long}\nown line {i}\n \t{long.upper()}\r\n{other if i % 2 else ''}") for i in range(9)]
    rows += [(4, f"{long}\n"), (None, long), (None, f"x\n{long}"), (20, None), (21, ""), (22, "\n\n"), (20, None)]
    rows += [(30, "\n".join(f"line {j} of a text with many lines, {long}" for j in range(3000)))]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id bigint, text string, n_lines int, k string")
    got = lines.drop_lines(docs)
    assert got.columns == ["doc_id", "text", "k", "n_lines", "n_dropped", "kept_text"]
    digests = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()]
    assert sorted(digests, key=str) == slow(rows)
    assert lines.drop_lines(docs.where("false")).count() == 0


def test_clashing_columns_and_ids_of_text(spark):
    line = "A line of text that is longer than forty characters"
    names = ["row", "k", "id", "dropped", "line", "pos", "kept_text", "__k"]
    docs = spark.createDataFrame([(f"d{i}", f"{line}\nown {i}", *map(str, range(len(names)))) for i in range(7)], ", ".join(f"{c} string" for c in ["doc_id", "text", *names]))
    got = lines.drop_lines(docs).collect()
    assert {r.doc_id: (r.n_dropped, r.kept_text) for r in got} == {f"d{i}": (int(i < 6), f"own {i}" if i < 6 else f"{line}\nown 6") for i in range(7)}
    assert all(r.row == "0" and r.k == "1" and r.pos == "5" for r in got)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.op6_line_dedup(spark, d).collect()]
    assert sorted(got, key=str) == slow(rows)
