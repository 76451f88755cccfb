"""Golden vectors, and comparison with the standard library on random input."""

import io
import random
import zipfile
from pathlib import PurePosixPath
from urllib.parse import unquote, urljoin

from pyspark.sql import functions as F

from folioscan.functions import filetypes, labels, metadata, urls
from folioscan.functions.text import percent_decode, strip


def check(apply, function, expected, types="string"):
    cases = [key if isinstance(key, tuple) else (key,) for key in expected]
    assert apply(function, cases, types) == list(expected.values())


def test_session(apply):
    vectors = {
        "2024 - épreuves normales": ("2024_NORMAL", "NORMAL"),
        "1998 - normale": ("2019_NORMAL", "NORMAL"),
        "24 septembre": ("2024_REMPLACEMENT", "REMPLACEMENT"),
        "épreuves normales": (None, "NORMAL"),
        "2024 - épreuves": (None, None),
        "2024 normaux": (None, None),
        " 2023 Session NORMALE\n": ("2023_NORMAL", "NORMAL"),
        "x2024 normale": (None, "NORMAL"),
        "normalée 2024": (None, None),
        "": (None, None),
        None: (None, None),
    }
    check(apply, labels.session_code, {k: v[0] for k, v in vectors.items()})
    check(apply, labels.session_kind, {k: v[1] for k, v in vectors.items()})


def test_discipline(apply):
    check(apply, labels.discipline, {
        "Français - dictée": "FR_DICTEE", "Français - questions": "FR_GRAM_COMP", "Français": None,
        "Francais - redaction": "FR_REDACTION", "Préhistoire": "HIST_GEO_EMC", "EMC": "HIST_GEO_EMC", "emcx": None,
        "Mathématiques": "MATHS", "Mathématique": None, "math": "MATHS", "Physique-chimie": "SCIENCES",
        "science": "SCIENCES", "LV hébreu": "LV_HEBREU", "LV hebreu": "LV_HEBREU", "langue turc": "LV_TURC", None: None,
    })


def test_serie_and_location(apply):
    check(apply, labels.serie, {
        "Générale et professionnelle": "GENERALE", "Pro": "PROFESSIONNELLE", "Professionnels": None,
        "Toutes séries": "TOUTES", "générales": None, "": None,
    })
    check(apply, labels.location, {
        "Métropole et Antilles-Guyane": "METRO_ANTIL_GUY", "Métropole et Antilles Guyane": "ANTIL_GUY",
        "Groupe 12": None, "Groupe  1": "GROUPE_1", "Europe": None, "Amérique  du Nord": "AM_NORTH",
        "la métropole et antilles-guyane": "METRO_ANTIL_GUY", "Antilles , Guyane": "ANTIL_GUY", " LIBAN ": "LIBAN",
    })


def test_sql_functions_agree(spark):
    names = labels.register_sql_functions(spark)
    assert names == sorted(labels.sql_functions())
    texts = ["2024 - épreuves normales", "Français - dictée", "Pro", "Groupe  1", "Métropole", "l'histoire", "Sciences ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    pairs = [
        (labels.session_code(t), "label_session_code(t)"), (labels.session_kind(t), "label_session_kind(t)"),
        (labels.discipline(t), "label_discipline(t)"), (labels.serie(t), "label_serie(t)"), (labels.location(t), "label_location(t)"),
    ]
    same = [column.eqNullSafe(F.expr(sql)).alias(f"s{i}") for i, (column, sql) in enumerate(pairs)]
    assert all(all(row) for row in df.select(*same).collect())


def test_years(apply):
    check(apply, metadata.file_year, {"24genfrdag1_v11.pdf": "2024", "98gen.pdf": "2098", "abc.pdf": None, "": None})
    check(apply, metadata.year, {
        ("", "2023-maths.pdf"): "2020", ("", "sujet 2023.pdf"): "2023", ("", "sujet_2023.pdf"): None,
        ("/document/2023/download", "download"): "2023", ("", "x 2031 2019"): "2019", ("", None): None,
    })


def test_metadata_words(spark):
    cases = [
        ("/document/123/download", "24genfrdag1_v11.pdf|63414", ("24genfrdag1_v11.pdf", "63414", "2024", None, None, "generale", False, "sujet")),
        ("/document/1/download", "|9", ("", "9", None, None, None, "generale", False, "sujet")),
        ("/document/1/download", "", ("download", None, None, None, None, "generale", False, "sujet")),
        ("x", None, ("x", None, None, None, None, "generale", False, "sujet")),
        ("/a", "turkey pro histoire-geographie juin.pdf|1|2", ("turkey pro histoire-geographie juin.pdf", "1", None, "Histoire-Géographie", "juin", "professionnelle", True, "correction")),
        ("/a", "hist-geo.pdf", ("hist-geo.pdf", None, None, "Histoire-Géographie", None, "generale", False, "sujet")),
        ("/a", "sujet%202021 maths", ("sujet%202021 maths", None, "2021", "Mathématiques", None, "generale", False, "sujet")),
    ]
    df = spark.createDataFrame([(i, u, a) for i, (u, a, _) in enumerate(cases)], "i int, url string, attribute string")
    rows = metadata.with_parsed(df, F.col("url"), F.col("attribute")).orderBy("i").select(*metadata.FIELDS).collect()
    assert [tuple(row) for row in rows] == [expected for *_, expected in cases]


def test_names(apply):
    check(apply, lambda *c: metadata.save_name(*c), {("1", "NORMAL", "FR_DICTEE", "GENERALE", "AM_NORTH", "63474"): "1_NORMAL_FR_DICTEE_GENERALE_AM_NORTH_63474"})
    check(apply, metadata.organized_name, {
        ("a.pdf", "2024", "x", "y", "z", "sujet", "1"): "a.pdf",
        ("", "2024", "Sciences (Physique/Chimie)", None, "generale", "sujet", "7"): "2024_Sciences_(Physique_Chimie)_generale_sujet_7.pdf",
        (None, None, "Français", "", None, "correction", ""): "Français_correction.pdf",
        (None, None, "éèàô", None, None, "sujet", None): "eeao_sujet.pdf",
    })
    check(apply, metadata.target_path, {("2024", "MATHS", "a"): "2024/MATHS/a", ("", "MATHS", "a"): "MATHS/a", (None, None, "a"): "a"})


def test_format_bytes(apply):
    check(apply, metadata.format_bytes, {
        0: "0.00 B", 1023: "1023.00 B", 1152: "1.12 KB", 1536: "1.50 KB", 1048575: "1024.00 KB", 1024**4: "1.00 TB", 1024**5: "1.00 PB", 5000 * 1024**5: "5000.00 PB",
    }, "bigint")


def test_sanitize(apply):
    def plain(name):
        import re

        return re.sub(r"[\s_]+", "_", re.sub(r'[<>:"/\\|?*]', "_", name)).strip("_ ")

    fixed = {"Sujet : Maths 2023.pdf": "Sujet_Maths_2023.pdf", "a" * 300: "a" * 255, "b" * 300 + ".pdf": "b" * 251 + ".pdf", "c" * 300 + ".": "c" * 255}
    check(apply, urls.sanitize, fixed)
    rng = random.Random(1)
    names = ["".join(rng.choice(" _a.é:/| \tZ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = apply(urls.sanitize, [(n,) for n in names])
    assert got == [plain(n) for n in names]
    assert apply(urls.sanitize, [(n,) for n in got]) == got


def test_extensions(apply):
    check(apply, urls.file_extension, {
        ("https://e.org/file.pdf", None): ".pdf", ("https://e.org/download", "24gen.PDF"): ".pdf", ("https://e.org/a.zip?x=1", None): ".zip",
        ("https://e.org/download", "download"): ".pdf", ("https://e.org/a.tar.gz", ""): ".gz", ("https://e.org", ".hidden"): ".pdf",
        ("https://e.org/a%2Ezip;v=1#f.doc", "x."): ".zip",
    })
    rng = random.Random(2)
    names = ["".join(rng.choice("./ab") for _ in range(rng.randint(0, 8))) for _ in range(400)]
    # names that end in a dot have no suffix here, whatever the Python version says
    names = [n for n in names if not PurePosixPath(n).name.endswith(".")]
    assert apply(urls.suffix, [(n,) for n in names]) == [PurePosixPath(n).suffix for n in names]


def test_url_names(apply):
    check(apply, urls.name_in_url, {"/document/1/download?x": "download", "plain": "plain", "a/": ""})
    check(apply, urls.safe_name_in_url, {"https://e.org/docs/file.pdf": "file.pdf", "https://e.org/docs/": "downloaded_file.pdf", "https://e.org/a%20b:c.pdf": "a_b_c.pdf"})


def test_percent_decode_and_strip(apply):
    texts = ["100%+x%zz%C3%A9", "a%20b", "%", "%4", "", "é%41+"]
    assert apply(percent_decode, [(t,) for t in texts]) == [unquote(t) for t in texts]
    padded = ["  a b \x1c\x85", "", "   "]
    assert apply(strip, [(t,) for t in padded]) == [t.strip() for t in padded]


def test_resolve_like_urljoin(apply):
    base = "https://listing.example.org/archive/list"
    known = ["", "/document/1/download", "document/1", "../x", "?q=1", "#f", "a/../b/./c", "../../../x", "mailto:x", "//h.org/a/../b", "/a//b", "a//b", "x?", "b?#f", "/..//x", "https:y", "HTTP://z/q", " /lead", "/a/..", ".", "..", "/a/./", "///p", "?", "#"]
    rng = random.Random(3)
    pieces = ["..", ".", "a", "b.c", "", "/", "?q", "#f", "//", "%20"]
    hrefs = known + ["/".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(500)]
    assert apply(lambda h: urls.resolve(base, h), [(h,) for h in hrefs]) == [urljoin(base, h) for h in hrefs]
    for other in ("https://e.org", "https://e.org/", "https://e.org/a/b/?x=1#y"):
        assert apply(lambda h: urls.resolve(other, h), [(h,) for h in known]) == [urljoin(other, h) for h in known]


def test_document_link(apply):
    check(apply, urls.is_document_link, {"/document/1/download": True, "x/document/a b/download?y": True, "/document//download": False, "/document/1/2/download": False})


def test_types(apply):
    check(apply, filetypes.content_type_extension, {
        "application/pdf; charset=utf-8": ".pdf", " Application/MSWORD ": ".doc", "application/octet-stream": None, "text/html": None, "": None, None: None,
    })
    check(apply, filetypes.magic_extension, {b"%PDF-1": ".pdf", b"PK\x03\x04x": ".zip", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": ".doc", b"\xd0\xcf\x11\xe0": ".bin", b"{\\rtf1": ".rtf", b"Rar!": ".rar", b"": ".bin", b"x%PDF": ".bin"}, "binary")
    check(apply, filetypes.renamed, {("a/b.pdf", ".zip"): "a/b.zip", ("a/b.PDF", ".pdf"): "a/b.PDF", ("a.c/b", ".doc"): "a.c/b.doc", ("a/.x", ".bin"): "a/.x.bin"})


def test_validity(apply):
    pdf = b"%PDF" + b"x" * 1019
    cases = {
        (".pdf", pdf): False, (".pdf", pdf + b"x"): True, (".pdf", b"x" * 2000): False, (".doc", b"x" * 1000): False, (".doc", b"x" * 1001): True,
        (".bin", b"x" * 100): False, (".bin", b"x" * 101): True, (".xls", b"x" * 100): True, (".xls", b"x" * 99): False, (".zip", b"x" * 500): False, ("", b"x" * 100): True,
    }
    check(apply, filetypes.is_valid, cases, "string binary")


def test_zip_test_like_zipfile(apply):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("a.txt", "hello" * 50)
    good = held.getvalue()
    end = b"PK\x05\x06" + b"\x00" * 18
    blobs = [
        good, good[:-5], good + b"tail", good + b"x" * 70000, b"junk" * 30 + good, b"", b"PK\x05\x06", end, end[:-1], b"a" * 10 + end,
        end + b"PK\x05\x06", end + end, end + b"c" * 65536, end + b"c" * 65537, b"\xff" * 200 + end + b"\xe9" * 9, end[:-2] + b"\x03\x00abc", b"PK\x03\x04" * 50,
    ]
    rng = random.Random(4)
    for _ in range(60):
        blobs.append(b"".join(rng.choice([end, b"PK\x05\x06", b"\x00\x00", b"\xff\xfe", b"abc"]) for _ in range(rng.randint(1, 12))))
    assert apply(filetypes.is_zip, [(b,) for b in blobs], "binary") == [zipfile.is_zipfile(io.BytesIO(b)) for b in blobs]
