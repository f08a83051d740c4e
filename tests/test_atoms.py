"""Headings carried forward within a page's row."""

from __future__ import annotations

from tesserae.operators import atoms as A

PAGE = "document_id string, page_number int, raw_text string, n_images int, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, tables array<struct<bbox:array<double>,headers:array<string>,rows:array<array<string>>>>"
TEXTS = {
    "heading first": ["KEY FIGURES", "revenue rose", " OTHER MATTERS ", "costs fell", "and 12"],
    "none": ["revenue rose", "costs fell"],
    "only headings": ["ONE", "TWO"],
    "last": ["revenue rose", "END"],
    "null and empty": [None, "", "ONE", None, "costs fell", " "],
    "empty": [],
    "long": [w for i in range(3000) for w in (f"part {i} of it", "NOTES" if i % 7 == 0 else f"line {i} is here")],
}


def pages(spark):
    rows = [(name, 1, "\n".join(t or "" for t in texts), 0, [(0.0, 0.0, 1.0, 1.0, t) for t in texts], []) for name, texts in TEXTS.items()]
    return spark.createDataFrame([*rows, ("null", 1, None, 0, None, None)], PAGE)


def is_heading(text):
    return bool(text and text.strip()) and text.strip() == text.strip().upper() and text.strip().lower() != text.strip()


def carried():
    for name, texts in TEXTS.items():
        heads = [t.strip() if is_heading(t) else None for t in texts]
        last = next((h for h in reversed(heads) if h), None)
        for i, t in enumerate(texts):
            yield name, i, t, next((h for h in reversed(heads[: i + 1]) if h), None), last, texts[i + 1] if i + 1 < len(texts) else None


def in_order(rows):
    return sorted(rows, key=lambda r: r[:2])


def test_paragraphs_take_the_heading_before_them_without_an_exchange(spark):
    got = A.blocks_with_headings(pages(spark)).select("document_id", "block_no", "text", "heading", "last_heading", "next_block.text").collect()
    assert in_order(tuple(r) for r in got) == in_order(carried())
    paragraphs = A.paragraph_atoms(pages(spark)).select("document_id", "block_no", "exact_text", "section_heading")
    assert in_order(tuple(r) for r in paragraphs.collect()) == in_order((d, i, t.strip(), h) for d, i, t, h, _, _ in carried() if t and len(t.strip()) >= 3 and not is_heading(t))
    assert "Exchange" not in paragraphs._jdf.queryExecution().executedPlan().toString()


def test_cards_take_the_block_after_them_without_an_exchange(spark):
    short = lambda t: any(c in "0123456789" for c in t) and len(t) < A.CARD_CHARS
    want = []
    for d, i, t, _, last, after in carried():
        one, two = (t or "").strip(), (after or "").strip()
        if len(one) > 1 and len(two) > 1 and (short(one) or short(two)):
            want.append((d, i, f"{one}\n{two}", last))
    cards = A.card_atoms(pages(spark)).select("document_id", "block_no", "exact_text", "section_heading")
    assert in_order(tuple(r) for r in cards.collect()) == in_order(want) and len(want) > 5000
    assert "Exchange" not in cards._jdf.queryExecution().executedPlan().toString()
