import math
import random
import re
import textwrap
from collections import Counter

import pytest

from sparkloom.llm import chat_format, license_scan, url_filter

# ---- licences


def slow_scan(files, model):
    """Every unit of every file against every template, then the directories up from each file."""
    templates = {}
    for k, name, t, w in model.weights:
        templates.setdefault((k, name), {})[t] = w

    def best(unit):
        bag = Counter(license_scan.terms(unit))
        x = {t: n * model.idf.get(t, model.unseen) for t, n in bag.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        dots = [(sum(v * w.get(t, 0) for t, v in x.items()), name) for (_, name), w in templates.items()] if norm else []
        scores = [(-round(d * (d / norm) ** 2, 6), -round(d / norm, 6), name) for d, name in dots if round(d / norm, 6) >= model.threshold]
        return min(scores, default=None)

    def units(text):
        """Lines; runs of two or more lines with terms; the lines before the first line of code."""
        lines = text.split("\n")
        found, run = list(lines), []
        for line in [*lines, ""]:
            if re.search("[A-Za-z0-9]", line):
                run.append(line)
                continue
            if 2 <= len(run) < len(lines):
                found.append("\n".join(run))
            run = []
        if re.match(license_scan.COMMENT, text.lstrip(" ")):
            head = []
            for line in lines:
                if re.search("[A-Za-z0-9]", line) and not re.match(license_scan.COMMENT, line):
                    break
                head.append(line)
            if len(head) >= 2:
                found.append("\n".join(head))
        return found

    own, covers = {}, {}
    for path, text in files:
        parts = [b for b in map(best, units(text or "")) if b]
        whole = best(text or "")
        own[path, text] = min([*parts, whole] if whole else parts, default=None)
        named, name = re.search(r"(^|/)(license|licence|copying|unlicense|notice)([._-][^/]*)?$", path.lower()), path.rpartition("/")[2].lower()
        cover = (whole or own[path, text]) if named else whole if "." not in name or name.endswith((".txt", ".md", ".rst", ".text")) else None
        if cover:
            folder = path.rpartition("/")[0]
            covers[folder] = min(covers.get(folder, cover), cover)
    out = []
    for path, text in files:
        found, origin, at = own[path, text], "own", None
        if not found:
            folder, origin = path.rpartition("/")[0], "none"
            while True:
                if folder in covers:
                    found, origin, at = covers[folder], "inherited", folder
                    break
                if not folder:
                    break
                folder = folder.rpartition("/")[0]
        out.append((path, found[2] if found else None, -found[1] if found else None, origin, at))
    return sorted(out, key=repr)


MIT, GPL, APACHE = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."
FILES = [
    ("LICENSE", GPL), ("src/LICENSE", MIT), ("src/a/b/code.py", "x = 1\ny = 2"), ("src/a/head.py", f"# {APACHE}\nimport this\n"), ("doc/x.md", "plain words"), ("src/a/b/COPYING", "licensed under CC BY-NC 4.0"),
    ("src/a/b/c/deep.py", ""), ("top.txt", None), ("prose.txt", "the license of this work is a matter of public debate under many versions of the law"),
    ("two.txt", f"{MIT}\n{APACHE}\nmore text of this file"), ("copy/LICENSE", MIT), ("copy/LICENSE", MIT), ("copy/none.txt", "a"), ("upper/LICENSE", APACHE.upper()), ("upper/z", "z"),
]


def scanned(df):
    return sorted(((r["path"], r["license"], r["score"], r["origin"], r["from_dir"]) for r in df.collect()), key=repr)


def test_license_scan_against_brute_force(spark, prose):
    rnd = random.Random(2)
    notices = [t for _, t in license_scan.TEMPLATES]
    files = FILES + [(p, t) for p, t, *_ in planted()] + [(f"r/{k % 5}/{k % 3}/f{k}", f"{p[:200]}\n{rnd.choice(notices)} {' '.join(p.split()[: rnd.randrange(6)])}\n{p[200:300]}") for k, p in enumerate(prose[:60])]
    model = license_scan.Model()
    got = license_scan.license_scan(spark.createDataFrame(files, "path string, text string"))
    want = slow_scan(files, model)
    rows = scanned(got)
    assert [r[:2] + r[3:] for r in rows] == [w[:2] + w[3:] for w in want]
    assert all(r[2] == pytest.approx(w[2], abs=2e-6) if r[2] is not None else w[2] is None for r, w in zip(rows, want, strict=True))


def wrapped(text, width, sign=""):
    """A text's paragraphs wrapped and put behind a comment sign."""
    return "\n".join((f"{sign} {line}").rstrip() for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


def planted():
    """(path, text, licence, is a licence file): full texts with a holder, wrapped headers over code, tags."""
    full = {name: max((t for n, t in license_scan.TEMPLATES if n == name), key=len) for name, _ in license_scan.TEMPLATES}
    code = "\nimport sys\n\ndef run(a, b):\n    return a + b * 2\n"
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        text = wrapped(full[name].replace("Copyright (c)", "Copyright (c) 2019-2024 Some Holder and contributors"), 79)
        yield f"{name}/LICENSE", text, name, True
        yield f"{name}/LICENSE.md", wrapped(text, 60), name, True
        yield f"{name}/head.c", f"/*\n{wrapped(text, 72, ' *')}\n */\nint main(void) {{ return 0; }}\n", name, False
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"):
        for width in (50, 78):
            yield f"src/{name}{width}.py", "# Copyright 2021 Some Holder\n#\n" + wrapped(full[name], width, "#") + code, name, False
        yield f"only/{name}.py", wrapped(full[name], 70, "#"), name, False
    yield "gpl/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Every word of the long text that follows here is left out.\n" * 400, "GPL-3.0", True
    yield "asf/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n" + "some long text of terms\n" * 200, "Apache-2.0", True
    for tag, name in (("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("GPL-2.0-only", "GPL-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("CC0-1.0", "CC0-1.0")):
        yield f"tag/{tag}.rs", f"// SPDX-License-Identifier: {tag}\nfn main() {{}}\n", name, False


def test_planted_licences(spark):
    cases = list(planted())
    rest = [(f"{p.rpartition('/')[0]}/deep/er/none.x", "no words of a licence") for p, *_ in cases]
    files = [(p, t) for p, t, *_ in cases] + rest
    rows = {r["path"]: r for r in license_scan.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [(p, rows[p]["license"], rows[p]["is_license_file"]) for p, *_ in cases] == [(p, n, f) for p, _, n, f in cases]
    assert {(rows[p]["license"], rows[p]["origin"]) for p, _ in rest if p.startswith("MIT/")} == {("MIT", "inherited")}
    assert {rows[p]["origin"] for p, _ in rest if p.startswith(("src/", "only/", "tag/"))} == {"none"}
    assert rows["gpl/deep/er/none.x"]["license"] == "GPL-3.0"


def test_an_unknown_tag_is_no_licence(spark):
    files = spark.createDataFrame([("a.rs", "// SPDX-License-Identifier: Own-1.0\n")], "path string, text string")
    assert license_scan.license_scan(files).first()["license"] is None


def test_license_edges(spark):
    extra = spark.createDataFrame([(None, MIT, "d", 1), (None, None, "d", 1), ("a/b", "word " * 90_000 + "\n" + MIT, "d", 1)], "path string, text string, dir string, score int")
    got = {(r["path"], r["license"], r["origin"]) for r in license_scan.license_scan(extra).collect()}
    assert got == {("", "MIT", "own"), ("", None, "none"), ("a/b", "MIT", "own")}
    assert license_scan.license_scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_a_file_without_a_path_covers_nothing(spark):
    files = spark.createDataFrame([(None, MIT), ("a/x.py", "pass"), ("z.py", "pass"), ("b/LICENSE", MIT), ("b/c/y.py", "pass")], "path string, text string")
    got = {r["path"]: (r["license"], r["origin"]) for r in license_scan.license_scan(files).collect()}
    assert got == {"": ("MIT", "own"), "a/x.py": (None, "none"), "z.py": (None, "none"), "b/LICENSE": ("MIT", "own"), "b/c/y.py": ("MIT", "inherited")}
    top = spark.createDataFrame([(None, "pass"), ("LICENSE", MIT), ("z.py", "pass")], "path string, text string")
    assert {r["path"]: r["origin"] for r in license_scan.license_scan(top).collect()} == {"": "none", "LICENSE": "own", "z.py": "inherited"}


def test_large_lookup_is_salted_with_equal_results(spark, monkeypatch):
    from sparkloom.llm import common

    df = spark.createDataFrame(FILES, "path string, text string")
    want = scanned(license_scan.license_scan(df))
    attach = common.attach
    monkeypatch.setattr(license_scan, "attach", lambda *a, **k: attach(*a, broadcast_rows=0, **k))
    assert scanned(license_scan.license_scan(df)) == want


# ---- urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("tie.io", "/a", "block"), ("tie.io", "/a", "allow"), ("io", "", "block")]
URLS = [
    "http://x.example.net/en/1", "https://EXAMPLE.net/de/?q=/en/", "http://example.com/de/x#y", "http://badexample.com/de/", "https://a.b.org/fr/", "https://a.b.org/frx", "no scheme.net/", None, "", "http://net", "http://net?x", "http://net/",
    "ftp://u@tie.io:80/abc", "http://tie.io/abc", "http://k.io", "://net/", "http://a.net/x://b.org/fr/", "http://Ä.NET/en/", "http://example.net./en/", "http://.net/", "http://example.net/en", "x://y.example.net/en/a b",
]


def slow_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


@pytest.mark.parametrize("digits", [8, 1])
def test_url_filter_against_brute_force(spark, digits):
    """One hex digit makes prefixes collide; full digests settle that."""
    # columns that have the operator's own names
    pages = spark.createDataFrame([(k, u, 1, 2, "x", 3, 4, 5) for k, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]], "page_id long, url string, host int, path int, rule string, verdict int, short int, digest int")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in url_filter.url_filter(pages, rules, prefix_digits=digits).collect())
    want = [(str(k), *slow_verdict(u)) for k, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]]
    assert got == sorted((k, h, p, str(r), v) for k, h, p, r, v in want)


def test_urls_and_rules_of_any_length(spark):
    """Rules beyond any usual length, and urls as long, against the same plain rule."""
    long = "/x" * 1051 + "/"
    rules = [("net", long, "block"), ("a.net", long + "deeper/", "allow"), ("org", "/", "block")]
    urls = [f"http://b.net{long}page", f"http://a.net{long}deeper/page", f"http://a.net{long}deep", f"http://net{long[:-1]}", "http://org/" + "y" * 50_000, f"http://{'s.' * 200}org/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.url_filter(pages, spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "block")], "host string, path string, action string")).collect()
    got = [r["verdict"] for r in sorted(found, key=lambda r: r["page_id"])]
    assert got == ["block", "allow", "block", "allow", "block", "block"]


def test_url_filter_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert url_filter.url_filter(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert url_filter.url_filter(one, rules).first()["verdict"] == "allow"


# ---- chat


def slow_pairs(rows):
    out = {}
    for pair in sorted({r[0] for r in rows if r[0] is not None}):
        side = {s_: sorted(((-1 if t is None else t), role or "", text or "") for p, s, t, role, text in rows if p == pair and s == s_) for s_ in chat_format.SIDES}
        turns = sorted({t for x in side.values() for t, _, _ in x})
        stop = next((t for t in turns if [x for x in side["chosen"] if x[0] == t] != [x for x in side["rejected"] if x[0] == t]), None)
        show = lambda xs: "".join(f"<|{r}|>\n{x}\n" for _, r, x in xs)
        prompt = [x for x in side["chosen"] if stop is None or x[0] < stop]
        row = [show(prompt), len(prompt)]
        for s in chat_format.SIDES:
            tail, at, spans = [x for x in side[s] if stop is not None and x[0] >= stop], 0, []
            for x in tail:
                n = len(show([x]))
                if x[1] == "assistant":
                    spans.append(f"{at}:{at + n}")
                at += n
            row += [show(tail), len(tail), ",".join(spans)]
        out[pair] = tuple(row)
    return out


def formatted(df):
    names = ("prompt", "prompt_turns", "chosen", "chosen_turns", "chosen_mask", "rejected", "rejected_turns", "rejected_mask")
    return {r["pair_id"]: tuple(r[n] for n in names) for r in chat_format.preference_rows(df).collect()}


def test_preference_rows_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for pair in range(40):
        common = [(t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(rnd.randrange(5))]
        for side in chat_format.SIDES:
            tail = [(len(common) + t, rnd.choice(["user", "assistant"]), rnd.choice(["yes", "no", "", None, "ünï🙂"])) for t in range(rnd.randrange(4))]
            rows += [(pair, side, *x) for x in common + tail]
    rows += [(90, "chosen", 0, "user", "alone"), (91, "rejected", None, None, None), (92, "chosen", 1, "user", "same"), (92, "rejected", 1, "user", "same"), (92, "chosen", 1, "user", "same"), (None, "chosen", 0, "user", "x"), (93, "other", 0, "user", "x")]
    rows += [(94, s, 0, "user", x) for s in chat_format.SIDES for x in ("tie a", "tie b")] + [(95, s, 0, "assistant", "long " * 50_000 + s) for s in chat_format.SIDES]
    rows += [(96, s, 0, "user", "said twice") for s in chat_format.SIDES for _ in range(2)] + [(96, "chosen", 1, "assistant", "yes")] * 3 + [(96, "rejected", 1, "assistant", "yes")]
    # columns that have the operator's own names
    df = spark.createDataFrame([(*r, 1, "x", 2, "y", 3, True) for r in rows], "pair_id long, side string, turn long, role string, text string, stop int, part string, chosen int, rejected string, n int, loss boolean")
    want = {k: v for k, v in slow_pairs(rows).items() if k != 93}
    assert formatted(df) == want
    assert want[96][1] == 2 and want[96][3] == 3 and want[96][6] == 1
    assert chat_format.preference_rows(df.limit(0)).count() == 0


def test_prompt_and_completions_give_back_both_conversations(spark, data):
    turns = chat_format.swapped_pairs(spark.read.parquet(f"{data}/conversations.parquet"))
    got = formatted(turns)
    rows = [tuple(r) for r in turns.select("pair_id", "side", "turn", "role", "text").collect()]
    assert got == slow_pairs(rows)
    assert sum(v[1] > 0 for v in got.values()) > len(got) / 2
