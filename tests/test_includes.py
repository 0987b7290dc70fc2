"""Sources of many files, against a plain recursion."""

import random
import re

from veritab.sources import files, includes

COMMAND = r"\\%s\{([^}]*)\}"


def by_recursion(main: str, sources: dict[str, str]) -> str:
    seen = set()

    def find(target):
        for path in (target, target + ".tex", target + ".ltx"):
            if path in sources:
                return sources[path]
        last = target.split("/")[-1]
        return next((sources[p] for p in sorted(sources) if p.endswith(("/" + last, "/" + last + ".tex"))), None)

    def grown(text):
        for command in ("input", "include"):
            while m := re.search(COMMAND % command, text):
                part = ""
                if m[1] not in seen:
                    seen.add(m[1])
                    part = grown(find(m[1]) or "")
                text = text[: m.start()] + part + text[m.end() :]
        return text

    return grown(sources[main])


def joined(spark, papers: dict[str, dict[str, str]]) -> dict[str, str]:
    rows = [(paper, path, text) for paper, sources in papers.items() for path, text in sources.items()]
    return {r.paper_id: r.text for r in files.papers(spark.createDataFrame(rows, "paper_id string, path string, text string")).collect()}


def test_random_graphs_against_recursion(spark):
    draw = random.Random(5)
    papers = {}
    for paper in range(30):
        n = draw.randint(1, 9)
        paths = ["main.tex"] + [draw.choice(["", "a/", "b/c/"]) + f"f{k}" + draw.choice([".tex", ".tex", ".ltx"]) for k in range(1, n)]
        names = [p for path in paths for p in (path, path.rsplit(".", 1)[0], path.split("/")[-1].rsplit(".", 1)[0], "x/" + path.split("/")[-1])] + ["gone"]

        def body(k, names=names):
            asks = [f"\\{draw.choice(['input', 'include'])}{{{draw.choice(names)}}}" for _ in range(draw.randint(0, 4))]
            return (r"\documentclass{a}" if k == 0 else "") + "".join(f"<{k}.{i}>{ask}" for i, ask in enumerate(asks)) + f"</{k}>"

        papers[f"p{paper}"] = {path: body(k) for k, path in enumerate(paths)}
    assert joined(spark, papers) == {p: by_recursion("main.tex", s) for p, s in papers.items()}


def test_a_deep_chain_and_odd_files(spark):
    deep = {"m.tex": r"\documentclass{a}\input{c1}."} | {f"c{k}.tex": f"{k} \\input{{c{k + 1}}}\\include{{c{k - 1}}}" for k in range(1, 14)}
    odd = {"m.tex": "\\documentclass{a} \\includegraphics{p} \\input\n[x] {p}|\\input{} % \\input{p}\n\\input*{p}\\include", "p.tex": None, "p.txt": "no"}
    got = joined(spark, {"deep": deep, "odd": odd, "none": {"x.tex": None, "y.tex": "unread"}})
    assert got["deep"].split() == [r"\documentclass{a}1", *map(str, range(2, 14)), "."]
    assert got["odd"] == "\\documentclass{a} \\includegraphics{p} | \n" and got["none"] == ""
    assert joined(spark, {"p": {"only.txt": "x"}}) == {}


def test_a_target_met_later_at_an_earlier_place(spark):
    """b is found first at the main file's second command, then two levels down at its first."""
    papers = {"p": {"m.tex": r"\documentclass{a}\input{a}-\input{b}", "a.tex": r"a\include{c}", "c.tex": r"c\include{b}", "b.tex": r"b\include{d}", "d.tex": "d"}}
    assert joined(spark, papers) == {"p": r"\documentclass{a}acbd-"}
    assert includes.COMMANDS == ["input", "include"]
