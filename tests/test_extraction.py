"""Extraction and table rows over a whole table against plain Python, one document at a time."""

from __future__ import annotations

import random
import re

import pytest
import regex

import __spark_entry__ as library
from tesserae.operators.extract import M_, METRICS, _groups
from tesserae.plans import queries as own

from .test_scalars import ATOMS

LINES = [text for _, text in ATOMS] + [
    "Key Figures", "OPERATIONS", "Service EBITDA: Rs. 1,204 mn", "99", "pin codes", "PTL freight tonnage: 1.4 mn tons", "no figure stands here.", "", "  ", "ab", "Retail inflation moderated to 4.9 per cent in FY25",
    "a loss of revenue: ₹12.5 Cr in Q3 FY24", "workforce strength 57,000", "current account deficit at 1.2% of GDP, cells, 7", "spoton joined the group", "The economic survey says so.",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = [None, "", "one line", "\n".join(LINES), "filler words, " * 5000 + "\n" + LINES[0]] + ["\n".join(rng.choices(LINES, k=rng.randint(1, 12))) for _ in range(60)]
    rows = list(enumerate(texts))
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def heading(s):
    titled = re.search("[A-Z]", s) and not re.search("(^|[^a-zA-Z])[a-z]", s) and not re.search("[a-zA-Z][A-Z]", s)
    return s != "" and len(s) < 90 and bool((s.upper() == s and s.lower() != s) or (titled and not s.endswith(".")))


def atoms(text):
    lines = [x.strip() for x in text.split("\n")]
    yield from (x for x in lines if not heading(x) and len(x) >= 3)
    short = lambda x: re.search("[0-9]", x) and len(x) < 40
    yield from (f"{x}\n{y}" for x, y in zip(lines, lines[1:], strict=False) if len(x) > 1 and len(y) > 1 and (short(x) or short(y)))


def hits(atom, page):
    text = " ".join(atom.split()).lower()
    low = page.lower()
    subject = "Spoton Logistics" if "spoton" in low else "Delhivery Limited" if "delhivery" in low else "Republic of India" if "economic survey" in low else "Delhivery Limited"
    for metric in METRICS:
        for pattern in metric.patterns:
            m = regex.search(pattern, text)
            groups = [g or "" for g in m.groups()][::-1] if m else []
            assert not m or len(groups) == _groups(pattern)
            number = next((g for g in groups if re.search("[0-9]", g)), None)
            if number is None:
                continue
            unit = next((g.strip() for g in groups if not re.search("[0-9]", g) and g.strip()), metric.unit)
            value = f"{number} {unit}"
            tokens = re.sub("[,₹%]", "", value).split()
            yield metric.predicate, value, "Republic of India" if metric.kind == M_ else subject, any(x in atom or x in atom.replace(",", "") for x in tokens)
            break


def test_extraction_of_all_documents(spark, tables):
    folder, rows = tables
    want = sorted((str(d), a, *h) for d, t in rows if t for a in atoms(t) for h in hits(a, t))
    got = own._extraction(own._line_pages(spark, folder)).collect()
    assert sorted((r["document_id"], r["evidence_text"], r["predicate"], r["value_raw"], r["subject_raw"], r["grounded"]) for r in got) == want
    assert len({w[2] for w in want}) > 8 and "4" in {w[0] for w in want}


def test_table_rows_of_all_documents(spark, tables):
    folder, rows = tables
    want = []
    for d, text in rows:
        head, *body = [x.split(",") for x in (text or "").split("\n")]
        for i, cells in enumerate(body):
            label = lambda j: head[j].strip() if j < len(head) else f"Col_{j}"  # noqa: E731, B023
            shown = " | ".join(f"{label(j)}: {c.strip()}" for j, c in enumerate(cells) if c.strip())
            if len(shown) >= 10:
                want.append((str(d), i, shown, (at if (at := text.find(cells[0].strip())) >= 0 else None) if cells[0] else None))
    got = library.queries()["table_row_documents"](spark, folder).collect()
    assert sorted((r["document_id"], r["row_index"], r["exact_text"], r["char_start"]) for r in got) == sorted(want) and len(want) > 100
