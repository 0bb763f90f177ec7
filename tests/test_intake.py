"""DOCX resume intake from real files (binaryFile scan)."""

import os

from hirelens.sources import intake


def test_docx_roundtrip_text():
    data = intake.docx_bytes("  Skills: SQL & Python\nLine <two>\n")
    assert intake.docx_text(data) == "Skills: SQL & Python\nLine <two>"


def test_intake_from_files(spark, tmp_dir):
    files = {"a.docx": intake.docx_bytes("Hello\nWorld"), "b.DOCX": intake.docx_bytes("   "),
             "c.pdf": b"%PDF-1.4", "d.txt": b"plain", "e.docx": b"not a zip"}
    for name, data in files.items():
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(data)
    got = {r.file_name: (r.status, r.raw_text)
           for r in intake.intake(intake.read_files(spark, tmp_dir)).collect()}
    assert got == {"a.docx": ("accepted", "Hello\nWorld"), "b.DOCX": ("no text", None),
                   "c.pdf": ("pdf reader not available", None), "d.txt": ("unsupported type", None),
                   "e.docx": ("unreadable", None)}


def test_accepted_resume_has_empty_skills(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "r.docx"), "wb") as f:
        f.write(intake.docx_bytes("SQL"))
    r = intake.intake(intake.read_files(spark, tmp_dir)).first()
    assert r.status == "accepted" and r.extracted_skills == []


def test_equal_file_names_of_two_users(spark):
    text = {"up/1/cv.docx": "Ann: SQL", "up/2/cv.docx": "Bob: Go", "up/2/old/cv.docx": "Bob: C", "up/3/cv.pdf": "x"}
    files = spark.createDataFrame([(p, intake.docx_bytes(t)) for p, t in text.items()], "path string, content binary")
    sent = spark.createDataFrame([("up/1/cv.docx", 1), ("up/2/cv.docx", 2), ("up/2/old/cv.docx", 2), ("up/3/cv.pdf", 3)],
                                 "path string, user_id long")
    rows = intake.resume_rows(intake.intake(files), sent, "2024-02-01 00:00:00").collect()
    assert sorted((r.user_id, r.raw_text) for r in rows) == [(1, "Ann: SQL"), (2, "Bob: C"), (2, "Bob: Go")]
    assert len({r.id for r in rows}) == 3 and {r.file_name for r in rows} == {"cv.docx"}


def test_a_file_without_content(spark):
    files = spark.createDataFrame([("a.docx", None), ("b.docx", bytearray(b""))], "path string, content binary")
    assert {r.path: r.status for r in intake.intake(files).collect()} == {"a.docx": "unreadable", "b.docx": "unreadable"}


def test_workers_hold_few_files_at_once():
    import pyarrow as pa
    n = 3 * intake.FILES_AT_ONCE + 1
    batch = pa.RecordBatch.from_pydict({"path": [f"{k}.docx" for k in range(n)], "text": [f"text {k}" for k in range(n)]})
    files = list(intake._build_batches(iter([batch])))
    read = list(intake._parse_batches(iter(files)))
    assert all(b.num_rows <= intake.FILES_AT_ONCE for b in files + read)
    assert [t for b in read for t in b.column("raw_text").to_pylist()] == [f"text {k}" for k in range(n)]
