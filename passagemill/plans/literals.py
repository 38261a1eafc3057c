"""Small literal tables for operators that the driver's tables never exercise."""

from __future__ import annotations

NAMES = ["capital.pdf", "user_guide.pdf", "x.pdf", "TECH_Spec.PDF", "db_columns.docx", "entity.docx", "brd-v2.pdf", "features.pdf", "kpi.xlsx", "quarterly_report.pdf", "getting_started.md", "tutorial.pdf", "integration.pdf", "", "onboarding_model.pdf"]
URLS = [
    "https://a.org/user_guide", "https://a.org/getting-started", "https://a.org/docs/x", "https://a.org/reference", "https://a.org/?q=api", "https://A.org/API/v1", "https://a.org/my_schema", "https://a.org/x/schema;v=1", "https://a.org/dashboard#kpi",
    "http://HOST.Example.COM", "example.com/Path?Q=1#f", " https://a.org/p;x/q;y?z ", "a.b:80/x", "//c.org/x", "https://a.org:8080/x?y=1&z=2", "mailto:x@y.z", "https://a.org/?", "", "   ", "https://a.org/a b",
]
POLICY = ["https://example.com/docs/a", "https://www.example.com/docs/b", "https://evilexample.com/docs/c", "https://example.com:8080/docs/private/d", "https://example.org/docs/e", "https://sub.example.com/blog/f", "https://example.com/docs/login"]
POLICY_SEED, POLICY_ALLOW, POLICY_DENY = "https://example.com/", ("/docs/", "/blog/"), ("private", "login$")
ROLES = ["developer", "dev", "engineer", "sql", "data_engineer", "data engineer", "ba", "business_analyst", "business analyst", "product_analyst", "product analyst", "new_joiner", "new joiner", "onboarding", "beginner", " Dev ", "BA", "", "chief", None]
SSE = [
    (1, 1, 'data: {"choices":[{"delta":{"role":"assistant"}}]}'), (1, 2, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), (1, 3, ""), (1, 4, ": comment"), (1, 5, 'data:{"choices":[{"delta":{"content":"lo "}}]}'), (1, 6, "data: {broken"), (1, 7, 'data: {"choices":[]}'), (1, 8, "data: [DONE]"), (1, 9, 'data: {"choices":[{"delta":{"content":"late"}}]}'),
    (2, 1, 'data: {"choices":[{"delta":{"content":""}}]}'), (2, 2, 'data: {"choices":[{"delta":{"content":" no end"}}]}'), (3, 1, "data: [DONE]"),
]
BODIES = [(1, '{"choices":[{"message":{"content":" said "}}]}'), (2, '{"choices":[]}'), (3, '{"choices":[{"message":{"content":null}}]}'), (4, "not json"), (5, "{}"), (6, '{"choices":[{"message":{"content":"first"}},{"message":{"content":"second"}}]}')]
CONTENTS = [(1, '{"candidates":[{"content":{"parts":[{"text":" a"},{"text":"b "}]}}]}'), (2, '{"candidates":[]}'), (3, '{"candidates":[{"content":{}}]}'), (4, "x"), (5, '{"candidates":[{"content":{"parts":[{"text":"one"}]}},{"content":{"parts":[{"text":"two"}]}}]}')]
STATUS = [200, 204, 299, 300, 400, 404, 429, 500, 503, 599, 600]
ATTEMPTS = [(n, limited) for n in range(1, 9) for limited in (False, True)]

# Pages of geometry: (page, ord, type, bbox or None, points or None), and (page, ord, x0, y0, x1, y1, text).
DRAWINGS = [
    (1, 1, "rect", (0.0, 100.0, 80.0, 140.0), None), (1, 2, "rect", (200.0, 100.0, 280.0, 140.0), None), (1, 3, "curve", (400.0, 100.0, 480.0, 140.0), None), (1, 4, "line", None, [(80.0, 120.0), (200.0, 120.0)]), (1, 5, "curve", None, [(280.0, 120.0), (340.0, 90.0), (400.0, 120.0)]), (1, 6, "line", None, [(80.0, 120.0)]), (1, 7, "line", None, [(40.0, 120.0), (60.0, 130.0)]), (1, 8, "fill", None, [(0.0, 0.0), (1.0, 1.0)]), (1, 9, "line", None, [(900.0, 900.0), (200.0, 120.0)]),
    (2, 1, "rect", (0.0, 0.0, 10.0, 10.0), None), (2, 2, "rect", (100.0, 0.0, 110.0, 10.0), None), (2, 3, "line", None, [(5.0, 69.0), (105.0, 5.0)]), (2, 4, "line", None, [(5.0, 69.5), (105.0, 5.0)]), (3, 1, "line", None, [(0.0, 0.0), (9.0, 9.0)]), (4, 1, "rect", (0.0, 0.0, 50.0, 50.0), None), (4, 2, "rect", (0.0, 0.0, 50.0, 50.0), None),
]
BLOCKS = [
    (1, 1, 0.0, 5.0, 300.0, 20.0, "Order  model"), (1, 2, 5.0, 105.0, 70.0, 120.0, "so_mstr"), (1, 3, 5.0, 122.0, 70.0, 135.0, "so_mstr header table"), (1, 4, 205.0, 110.0, 270.0, 130.0, "sod_det\nlines"), (1, 5, 410.0, 142.0, 470.0, 150.0, "pt_mstr parts"), (1, 6, 130.0, 112.0, 150.0, 118.0, "1:n"), (1, 7, 320.0, 70.0, 360.0, 80.0, "x" * 200), (1, 8, 0.0, 1.0, 9.0, 2.0, " \n "),
    (2, 1, 0.0, 2.0, 8.0, 8.0, "aa"), (2, 2, 102.0, 2.0, 108.0, 8.0, "bb"), (2, 3, 100.0, 300.0, 120.0, 310.0, "T" * 81), (3, 1, 0.0, 0.0, 9.0, 9.0, "only lines"), (4, 1, 10.0, 10.0, 20.0, 20.0, "z"), (4, 2, 10.0, 12.0, 30.0, 22.0, "yy"), (4, 3, 10.0, 12.0, 30.0, 22.0, "zz"),
]
DIAGRAM_PAGES = [(1, "manual.pdf", 3), (2, "b.pdf", 1), (3, "c.pdf", 1), (4, "d.pdf", 9)]

# A site: url, the words of its text, its links in order.
SITE = [
    ("https://s.org/", 40, ["/a", "b?x=1", "/a#top", "https://other.org/", "mailto:x@s.org", "/c"]), ("https://s.org/a", 40, ["/d", "/", "/e"]), ("https://s.org/b?x=1", 2, ["/f", "/d"]), ("https://s.org/c", 40, ["/private/g", "/h"]),
    ("https://s.org/d", 40, ["/i"]), ("https://s.org/e", 40, []), ("https://s.org/f", 40, ["/j"]), ("https://s.org/h", 40, ["/missing"]), ("https://s.org/i", 40, ["/k"]), ("https://s.org/j", 40, []), ("https://s.org/k", 40, []), ("https://other.org/", 40, ["https://s.org/z"]), ("https://s.org/private/g", 40, []),
]
SITE_PAGES = 7
PAGE_ROWS = [(i, text, images, erd, ocr) for i, (text, images, erd, ocr) in enumerate([(t, m, e, o) for t in ("a text that is long enough", "short", None) for m in (True, False) for e in ("a diagram's summary of boxes", "tiny", None) for o in ("what a machine has read here", " few ", None)])]
