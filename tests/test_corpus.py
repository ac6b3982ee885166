"""Plans and notes as units, from strings and from folders."""

from harvestry.functions import outline
from harvestry.sources import corpus

PLAN = """\
#+TITLE: Systems
#+SUBTITLE: How it is put together

Everything about serving.

* LLM inference and serving
Prose about the section.
** TODO Cache transfer   :ml:infra:
SCHEDULED: <2026-08-20 Thu>
:PROPERTIES:
:ID: 1234
:END:
Move the cache.
* Another area
Unrelated body.
"""
NOTE = "Opening line.\n\n## Watermarking\nStatistical watermarking.\n---\n#### deeper\nmore\n\n## Detection\nCurvature.\n"


def test_plan():
    assert [tuple(u) for u in outline.outline_units(PLAN, "ML/Systems.org")] == [
        ("org-charter", 1, "ML/Systems.org", "Systems", None, "Systems. How it is put together. Everything about serving."),
        ("org-section", 6, "ML/Systems.org", "LLM inference and serving", None, "ML/Systems.org > LLM inference and serving. Prose about the section."),
        ("org-task", 8, "ML/Systems.org > LLM inference and serving", "Cache transfer", "TODO", "ML/Systems.org > LLM inference and serving > Cache transfer. Move the cache."),
        ("org-section", 14, "ML/Systems.org", "Another area", None, "ML/Systems.org > Another area. Unrelated body."),
    ]
    assert list(outline.outline_units("", "f")) == [] and [u.kind for u in outline.outline_units("* TODOS x\n*bold*", "f")] == ["org-section"]


def test_note():
    assert [(u.title, u.line, u.path, u.text) for u in outline.note_units(NOTE, "Notes/D.md")] == [
        ("D", 1, "Notes/D", "Notes/D. Opening line."), ("Watermarking", 4, "Notes/D > Watermarking", "Notes/D > Watermarking. Statistical watermarking. more"), ("Detection", 10, "Notes/D > Detection", "Notes/D > Detection. Curvature."),
    ]
    body = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(10))
    units = list(outline.note_units(f"## Section\n{body}\n", "Long.md", 50))
    assert [u.line for u in units] == [2, 4, 7, 9] and units[0].path == "./Long > Section"
    assert " ".join(u.text.split(". ", 1)[1] for u in units).split() == body.split()


def test_folders(spark, tmp_path):
    for name, text in {"p/ML/Systems.org": PLAN, "p/init.org": PLAN, "p/.git/x.org": PLAN, "p/a b+c%.org": "* Ünit\n", "p/empty.org": "", "n/Notes/D.md": NOTE, "n/.obsidian/y.md": NOTE, "n/readme.txt": NOTE}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = corpus.read_corpus(spark, str(tmp_path / "p"), f"file://{tmp_path}/n").collect()
    assert sorted({(r["source"], r["file"]) for r in rows}) == [("org", "ML/Systems.org"), ("org", "a b+c%.org"), ("vault", "Notes/D.md")]
    assert [r["title"] for r in rows if r["file"].startswith("a b")] == ["Ünit"] and sum(r["source"] == "vault" for r in rows) == 3


def test_null_files(spark):
    files = spark.createDataFrame([("a.org", None, 1), (None, "* x", 2)], "file string, text string, line int")
    assert [tuple(r) for r in corpus.plan_units(files).select("file", "kind", "path").collect()] == [(None, "org-section", "")]
