import zlib

import pytest

from quarry.sources import documents, pdf


def stream(data, extra=b"", squeeze=True):
    body = zlib.compress(data) if squeeze else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if squeeze else b"", extra, body)


def made(objects, trailer=b"/Root 1 0 R /Info 9 0 R"):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects) + b"trailer << " + trailer + b" >>\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <4fe1> endbfchar 2 beginbfrange <0002> <0003> <606f> <0005> <0006> [<0041> <00420043>] endbfrange"


def book(trailer=b"/Root 1 0 R /Info 9 0 R"):
    first = b"BT /F1 12 Tf (Hello \\(big\\) w\\157rld) Tj 0 -14 Td [(sp) -30 (lit) -400 (apart)] TJ T* (next) ' ET /X1 Do"
    second = b"BT /F2 9 Tf <0001000200030006> Tj ET BI /W 1 ID \x00(\xff EI"
    return made([
        (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 10 0 R >> >> >>"),
        (3, b"<< /Type /Page /Contents 8 0 R >>"), (4, b"<< /Type /Page /Contents [7 0 R] >>"), (5, b"<< /Type /Font /Subtype /Type1 >>"), (6, b"<< /Type /Font /Subtype /Type0 /ToUnicode 11 0 R >>"),
        (7, stream(first)), (8, stream(second, squeeze=False)), (9, b"<< /Title <feff4fe1606f> >>"), (10, stream(b"BT /F1 1 Tf (form) Tj ET", b"/Subtype /Form")), (11, stream(CMAP)),
    ], trailer)


def test_text_and_title():
    assert documents.document_text(book(), "pdf") == "Hello (big) world split apart next form 信息恰BC"
    assert documents.metadata_title(book(), "PDF") == "信息"


def test_objects_in_streams():
    inner = b"1 0 2 34 3 94 <</Type /Catalog /Pages 2 0 R >>  <</Type /Pages /Kids [3 0 R] /Resources << /Font <<>> >> >>    <</Type /Page /Contents 5 0 R>>"
    first = inner.index(b"<<")
    parts = [inner[first:].index(x) for x in (b"<</Type /Catalog", b"<</Type /Pages", b"<</Type /Page /")]
    inner = b" ".join(b"%d %d" % x for x in zip((1, 2, 3), parts, strict=True)) + b" " + inner[first:]
    first = inner.index(b"<<")
    body = made([(4, stream(inner, b"/Type /ObjStm /N 3 /First %d" % first)), (5, stream(b"BT (packed) Tj ET")), (6, stream(b"", b"/Type /XRef /Root 1 0 R"))], b"")
    assert documents.document_text(body, "pdf") == "packed"


def test_what_cannot_be_read_is_empty():
    assert documents.document_text(book(b"/Root 1 0 R /Encrypt 12 0 R"), "pdf") == ""
    for broken in (b"", b"%PDF-1.4", b"no pdf at all", book()[:300], b"1 0 obj << /Kids [1 0 R] /Type /Pages >> endobj trailer << /Root 1 0 R >>"):
        assert isinstance(documents.document_text(broken, "pdf"), str) and documents.metadata_title(broken, "pdf") == ""


@pytest.mark.parametrize("cut", range(0, 1200, 97))
def test_a_cut_file_never_fails(cut):
    assert isinstance(documents.document_text(book()[:cut], "pdf"), str)


def test_what_unfolds_without_end_is_empty():
    many = b" ".join(b"<%08x> <%08x> <0041>" % (i << 16, (i << 16) + 0xFFFF) for i in range(40))
    body = made([(1, b"<< /Type /Page /Resources << /Font << /F 2 0 R >> >> /Contents 3 0 R >>"), (2, b"<< /ToUnicode 4 0 R >>"), (3, stream(b"BT /F 1 Tf <00000000> Tj ET")), (4, stream(b"1 beginbfrange " + many + b" endbfrange"))])
    assert documents.document_text(body, "pdf") == ""
    forms = [(10 + i, stream(b"/X Do " * 60, b"/Subtype /Form /Resources << /XObject << /X %d 0 R >> >>" % (11 + i))) for i in range(6)]
    body = made([(1, b"<< /Type /Page /Resources << /XObject << /X 10 0 R >> >> /Contents 3 0 R >>"), (3, stream(b"/X Do")), *forms, (16, stream(b"BT (again) Tj ET", b"/Subtype /Form"))])
    assert documents.document_text(body, "pdf") == ""


def test_values():
    assert pdf.parse(b"<< /A [1 -2.5 (x\\)y(z)) <4 1 4> 7 0 R] /B true >>") == [{"/A": [1, -2.5, b"x)y(z)", b"A@", pdf.Ref(7)], "/B": b"true"}]
