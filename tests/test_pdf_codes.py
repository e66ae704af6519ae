"""The text of a PDF's showing operators, code by code."""

import random
import time

import pytest

from leafwright.sources import pdf


def plain(raw, wide, table):
    out = []
    for k in range(0, len(raw), wide):
        code = int.from_bytes(raw[k : k + wide], "big")
        letter = table.get(code, " " if wide == 1 and code < 32 else None)
        if letter is None:
            raise pdf.PdfError(f"no letter is known for code {code} of a font")
        out.append(letter)
    return "".join(out)


def test_codes_are_read_as_one_by_one():
    """Known and unknown codes, control codes, half a code at the end, letters of several characters; in under half the time of single codes."""
    r, both = random.Random(3), pdf.Pdf.shown
    tables = [(1, {k: chr(k) for k in range(65, 123)} | {66: "ffi"}), (2, {k: chr(k % 50 + 65) for k in range(0x200, 0x300)} | {0xD800: "\ud800", 7: "half"})]
    errors = 0
    for _ in range(600):
        wide, table = r.choice(tables)
        known = [k.to_bytes(wide, "big") for k in table]
        raw = b"".join(r.choice(known) for _ in range(r.randrange(6))) + r.choice([b"", b"", b"\x07", b"\x01\xff"])
        given = b"<" + raw.hex().encode() + b">"
        try:
            want = plain(raw, wide, table)
        except pdf.PdfError as e:
            errors += 1
            with pytest.raises(pdf.PdfError, match=str(e)):
                both(b"Tj", [given], (wide, table))
        else:
            assert both(b"Tj", [given], (wide, table)) == want
    assert 0 < errors < 500
    raw, times = bytes(r.choice(range(65, 123)) for _ in range(300_000)), []
    for f in (lambda: plain(raw, *tables[0]), lambda: both(b"Tj", [b"<" + raw.hex().encode() + b">"], tables[0])):
        start = time.process_time()
        f()
        times.append(time.process_time() - start)
    assert times[1] < times[0] / 2
