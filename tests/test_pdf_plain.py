from pyspark.sql import functions as F

from passagemill.sources import files, fixtures, pdf


def test_pages_without_boxes_are_not_dealt_out(spark):
    """Only pages with a box can have a diagram; of the others no text is shuffled."""
    rows = [(f"/docs/a_{k}.pdf", fixtures.pdf_bytes([fixtures._lines(f"only words {k} on this page, and long enough", 40, 770)])) for k in range(6)]
    found = spark.createDataFrame(rows, "path string, content binary")
    made = files.page_documents(files.pdf_pages(found, files.pdf_reader()).localCheckpoint())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") or "\n+- Union" in plan or "Union" in plan.split("Join")[0]
    assert [r["text"] for r in made.orderBy("source").collect()] == [f"only words {k} on this page, and long enough" for k in range(6)]


def test_strings_with_escapes_and_codes_are_read_once():
    said = rb"(a\(b\)c(d\\)e\101\7z\n\
f)"
    assert pdf.Parser(said).object() == b"a(b)c(d\\)eA\x07z\nf"
    font = pdf.Font.__new__(pdf.Font)
    font.wide, font.names, font.widths, font.default, font.codec, font.known = False, {66: "X"}, {65: 600.0}, 500.0, "cp1252", {}
    assert font.read(b"AB A") == [("A", 0.6, False), ("X", 0.5, False), (" ", 0.5, True), ("A", 0.6, False)]
    assert set(font.known) == {65, 66, 32}
