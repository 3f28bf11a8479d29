import random

from quillon.llm import ocr

OCR = "candidate_no long, pack_id string, document_title string, source_path string, page int, decision string, originaltext string, text string, mark string"
PACK = "id string, title string, page string"
WORDS = "sample temperature record observation storage cabinet reviewer quotation measured reference container manufacturer edition appendix well-known follow-up".split()


def scan(r, pages, path, title, pack_title):
    """Pages of a scan with what is true of their lines: (lines, text, truth, page)."""
    out = []
    for page in range(1, pages + 1):
        lines, truth, paras = [f"{title} … {page}"], {(1, "furniture")}, []
        for _ in range(3):
            words = [r.choice(WORDS) for _ in range(r.randint(24, 40))]
            words[0] = words[0].capitalize()
            words[-1] += "."
            clean, line, broken = [], "", False
            own = []
            for w in words:
                shown = w
                wrong = "e" in w and r.random() < 0.02
                if wrong:
                    shown = w.replace("e", "c", 1)
                clean.append(w)
                if len(line) + len(shown) > 58:
                    if len(shown) > 7 and "-" not in shown and not wrong and r.random() < 0.5:
                        lines.append((line + " " + shown[:4]).strip() + "-")
                        truth.add((len(lines), "broken_word"))
                        own.append(len(lines))
                        line = shown[4:]
                        continue
                    lines.append(line)
                    line = shown
                else:
                    line = (line + " " + shown).strip()
                if wrong:
                    truth.add((len(lines) + 1, "misread_word"))
            lines.append(line)
            del broken
            paras.append(" ".join(clean))
            lines.append("")
        lines.append(f"- {page} -")
        truth.add((len(lines), "furniture"))
        out.append((lines, "\n\n".join(paras), truth, page))
    return out


def corpus():
    r = random.Random(8)
    rows, truth, texts, no = [], {}, {}, 0
    for s in range(12):
        title = f"Storage of Karemol{chr(97 + s)}"
        for lines, text, true, page in scan(r, 6, s, title, "Pack"):
            no += 1
            sep = "\r\n" if s % 4 == 0 else "\n"
            rows.append((no, "p", title, f"scan{s}.pdf", page, "accept" if page % 2 else "pending", sep.join(lines), text if page % 2 else None, "x"))
            truth[no], texts[no] = true, text
    rows += [(1000, "p", None, "z.pdf", None, "pending", None, None, None), (1001, None, "t", None, 1, "dismiss", "", None, None), (1002, "p", "t", "y.pdf", 1, "pending", "word " * 20_000, None, None)]
    return rows, truth, texts


def test_lines_and_paragraphs(spark, save):
    rows, truth, texts = corpus()
    save("catalog", [("p", "Pack", "x")], PACK)
    where = save("ocr_candidates", rows, OCR)
    got = {}
    for r in ocr.found(spark, where).collect():
        got.setdefault(r["candidate_no"], set()).add((r["line_no"], r["kind"]))
    for kind, recall in (("furniture", 0.99), ("broken_word", 0.97), ("misread_word", 0.9)):
        want = {(n, line) for n, t in truth.items() for line, k in t if k == kind}
        have = {(n, line) for n, t in got.items() if n < 1000 for line, k in t if k == kind}
        assert len(want & have) >= recall * len(want), kind
        assert len(have - want) <= 0.05 * len(want) + 2, kind
    assert 1000 not in got and 1001 not in got
    paras = {r["candidate_no"]: r["text"] for r in ocr.paragraphs(spark, where).collect()}
    assert len(paras) == len(rows) and paras[1000] is None
    exact = sum(paras[n] == t for n, t in texts.items())
    assert exact >= 0.85 * len(texts)


def test_breaks_without_hyphen_at_any_size(spark, save):
    """Fragments that many pages repeat stay breaks, two words in a row stay two words."""
    rows, truth, _ = corpus()
    pages, want = [], set()
    for no, *rest in rows[:72]:
        lines = rest[5].split("\n")
        for i in range(no % 3, len(lines), 3):
            if lines[i].rstrip("\r").endswith("-") and (i + 1, "broken_word") in truth[no]:
                lines[i] = lines[i].replace("-\r", "\r").removesuffix("-")
                want.add((no, i + 1))
        rest[5] = "\n".join(lines)
        pages.append((no, *rest))
    save("catalog", [("p", "Pack", "x")], PACK)
    found = []
    for copies in (1, 6):
        many = [(no + 1000 * c, pack, title, f"{c}{path}", *rest) for c in range(copies) for no, pack, title, path, *rest in pages]
        where = save("ocr_candidates", many, OCR)
        found.append({(r["candidate_no"], r["line_no"]) for r in ocr.found(spark, where).where("kind = 'broken_word'").collect()})
    assert len(want) > 50 and len(want & found[0]) >= 0.95 * len(want)
    assert {(no + 1000 * c, line) for c in range(6) for no, line in found[0]} == found[1]
    every = {(no, line) for no, t in truth.items() for line, kind in t if kind == "broken_word"}
    assert len(found[0] - every) <= 0.02 * len(every)


def test_repairs_and_odd_words():
    forms = ocr.repairs("sh0ws", {"0": [("o", 0.01)]})
    assert "shows" in forms
    assert ocr.odd_number("l84") and ocr.odd_number("1O") and not ocr.odd_number("184") and not ocr.odd_number("mol")
    assert ocr.digits_inside("sh0ws") and not ocr.digits_inside("vitamin12")


def test_alignment_names_the_states():
    lines = ["Title 3", "First line goes on with the rec-", "ord of a test.", "", "Second part.", "3"]
    got = [s for s, _, _ in ocr.align(lines, "First line goes on with the record of a test.\n\nSecond part.")]
    assert got == [ocr.FURNITURE, ocr.BREAK, ocr.BODY, ocr.BLANK, ocr.BREAK, ocr.FURNITURE]


def test_empty(spark, save):
    save("catalog", [], PACK)
    where = save("ocr_candidates", [], OCR)
    assert ocr.found(spark, where).count() == 0
    assert ocr.paragraphs(spark, where).count() == 0
