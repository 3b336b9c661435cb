import random

from sparkloom.llm import line_templates

LINE = "please read the terms of use before you go on with the rest of this page today"


def slow(docs):
    """Every template's documents, then every line against them."""
    first = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            for t in line_templates.templates(line):
                if doc_id is not None:
                    first[t] = min(first.get(t, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        if text is None:
            out.append((doc_id, None))
            continue
        kept = [x for x in text.split("\n") if not any(t in first and (doc_id is None or first[t] < doc_id) for t in line_templates.templates(x))]
        out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=repr)


def cleaned(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(((r["doc_id"], r["text"]) for r in line_templates.cleaned(df).collect()), key=repr)


def test_templates_generalise_fields():
    base = set(line_templates.templates(LINE))
    assert base & set(line_templates.templates(LINE.replace("terms of", "rules of")))
    assert base & set(line_templates.templates(LINE.upper()))
    assert base & set(line_templates.templates(LINE.replace("terms", "rules").replace("today", "now")))  # two fields
    assert not base & set(line_templates.templates(LINE.replace("read", "see").replace("before", "till").replace("today", "now")))  # three
    assert not base & set(line_templates.templates("and " + LINE))
    assert not base & set(line_templates.templates(LINE.replace("please", "kindly")))  # leading tokens are the path
    assert set(line_templates.templates("posted on 2024-01-02 by a@b.example to 17 readers")) & set(line_templates.templates("posted on 2023-11-30 by c@d.example to 9 readers"))
    assert line_templates.templates("Too short line") == line_templates.templates("too short  line") != line_templates.templates("too short text")
    assert line_templates.templates("page 12") != line_templates.templates("page 13") and line_templates.templates(" \t") == []


def test_against_brute_force(spark, prose):
    docs = [(k, "\n".join(t[i : i + 150] for i in range(0, len(t), 150)) + f"\n{LINE if k % 3 else LINE.replace('terms of', 'rules of')}") for k, t in enumerate(prose)]
    docs += [(None, prose[0]), (None, LINE), (None, "a line that only rows without id have here"), (None, "a line that only rows without id have here"), (500, None), (501, ""), (3, docs[3][1])]
    assert cleaned(spark, docs) == slow(docs)


def test_first_document_keeps_its_lines(spark):
    got = dict(cleaned(spark, [(5, f"{LINE}\nown words of the fifth here"), (2, f"head of two is here now\n{LINE}"), (9, LINE)]))
    assert got == {5: "own words of the fifth here", 2: f"head of two is here now\n{LINE}", 9: ""}


def test_edges(spark, clashing, empty_docs):
    out = line_templates.cleaned(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert {r["text"] for r in out.filter("doc_id = 1").collect()} == {"alpha beta gamma delta epsilon zeta"}
    assert line_templates.cleaned(empty_docs).count() == 0
    assert out.filter("doc_id = 4").first()["n_chars"] == len(out.filter("doc_id = 4").first()["text"])


def test_long_passages_that_repeat_are_caught(spark, prose):
    passage = " ".join(prose[5].split()[:60])
    docs = [(k, f"{prose[k]}\n{passage}") for k in range(10, 20)]
    got = dict(cleaned(spark, docs))
    assert passage in got[10] and not any(passage in got[k] for k in range(11, 20)) and all(prose[k] in got[k] for k in range(10, 20))


def test_recall_of_edited_passages(spark, prose):
    """Planted passages of 60 words with up to four edited words: how many are caught in all documents but the first."""
    rnd = random.Random(9)
    docs, planted = [], {}
    for k in range(100):
        words = [f"p{chr(97 + k % 26)}{rnd.choice('xyz')}{w}" for w in prose[k].split()[:30] * 2]
        docs.append((2 * k, f"{prose[k]}\n{' '.join(words)}"))
        for _ in range(1 + k % 4):
            words[rnd.randrange(60)] = "edited"
        planted[2 * k + 1] = " ".join(words)
        docs.append((2 * k + 1, f"{' '.join(reversed(prose[k].split()))}\n{planted[2 * k + 1]}"))
    got = dict(cleaned(spark, docs))
    caught = {edits: [planted[d] not in got[d] for d in planted if 1 + (d // 2) % 4 == edits] for edits in (1, 2, 3, 4)}
    assert sum(caught[1]) >= 24 and sum(caught[2]) >= 23 and sum(caught[3]) >= 14
    assert all("".join(text.split("\n")[0]) in got[d] for d, text in docs)
