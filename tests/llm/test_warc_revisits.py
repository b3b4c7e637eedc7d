import datetime as dt

from spotframe.llm import queries, warc_revisits

SCHEMA = "record_id long, kind string, uri string, date timestamp, http string, bucket string"
T0 = dt.datetime(2024, 1, 1)


def response(i, uri, minute, etag=None, since=None, status=200, more=""):
    head = "".join(f"\r\n{n}: {v}" for n, v in (("ETag", etag), ("Last-Modified", since)) if v)
    return (i, "response", uri, T0 + dt.timedelta(minutes=minute), f"HTTP/1.1 {status} OK{head}{more}", "b")


def revisit(i, uri, minute, etag=None, since=None, status=304, more=""):
    head = "".join(f"\r\n{n}: {v}" for n, v in (("etag", etag), ("last-modified", since)) if v)
    return (i, "revisit", uri, T0 + dt.timedelta(minutes=minute), f"HTTP/1.1 {status} Not Modified{head}{more}", "b")


ROWS = [
    response(1, "http://www.Ex.org:80/a/?b=2&a=1#x", 0, '"v1"', more="\r\nContent-Type: text/html\r\nExpires: 1"),
    response(2, "https://ex.org/a?a=1&b=2", 10, '"v2"', "Mon"),
    response(3, "http://ex.org/a?a=1&b=2", 20, '"v3"', status=404),
    revisit(10, "http://ex.org/a?b=2&a=1", 5, 'W/"v1"', more="\r\nExpires: 9\r\nContent-Type: text/plain\r\nServer: s"),
    revisit(11, "http://ex.org/a?b=2&a=1", 10, '"v2"'),          # not strictly earlier: v1 is the stored one
    revisit(12, "http://ex.org/a?b=2&a=1", 30, '"v2"'),          # the 404 is no full response
    revisit(13, "http://ex.org/a?b=2&a=1", 31, None, "Mon"),
    revisit(14, "http://ex.org/a?b=2&a=1", 31, None, "Tue"),
    revisit(15, "http://ex.org/a?b=2&a=1", 32),
    revisit(16, "http://ex.org/other", 32),
    revisit(17, None, 32),
    (18, "revisit", "http://ex.org/a?b=2&a=1", None, "HTTP/1.1 304 Not Modified", "b"),
    revisit(19, "http://ex.org/a?b=2&a=1", 33, status=200),
    (20, "revisit", "http://ex.org/a?b=2&a=1", T0, None, "b"),
    response(4, "ex.org/tie", 1, '"a"'), response(5, "ex.org/tie", 1, '"b"'), revisit(21, "ex.org/tie/", 2, '"b"'),
]
WANT = {10: (1, "resolved"), 11: (1, "mismatch"), 12: (2, "resolved"), 13: (2, "resolved"), 14: (2, "mismatch"),
        15: (2, "resolved"), 16: (None, "unmatched"), 17: (None, "unmatched"), 18: (None, "unmatched"),
        19: (2, "not_304"), 20: (None, "not_304"), 21: (5, "resolved")}


def test_latest_earlier_response(llm):
    records = llm.createDataFrame(ROWS, SCHEMA)
    for buckets in (1000, 1, 4):
        got = {r.record_id: r for r in warc_revisits.resolve(records, buckets).collect()}
        assert {k: (r.response_id, r.outcome) for k, r in got.items()} == WANT
    assert got[10].headers == {"etag": 'W/"v1"', "content-type": "text/html", "expires": "9"}
    assert got[11].headers is None and got[10].uri == "ex.org/a?a=1&b=2"
    bodies = records.withColumn("body", records["record_id"].cast("string"))
    got = warc_revisits.with_bodies(warc_revisits.resolve(records), bodies).collect()
    assert {r.record_id: r.body for r in got}[12] == "2"


def test_hot_uri_matches_brute_force(llm):
    rows = [response(i, "u.org/x", i * 7 % 500, f'"{i}"') for i in range(200)] + \
           [revisit(1000 + i, "u.org/x", i * 3 % 500) for i in range(200)]
    got = {r.record_id: r.response_id for r in warc_revisits.resolve(llm.createDataFrame(rows, SCHEMA), 16).collect()}
    for i, _, _, at, _, _ in rows[200:]:
        earlier = [(d, k) for k, _, _, d, _, _ in rows[:200] if d < at]
        assert got[i] == (max(earlier)[1] if earlier else None)


def test_repeats_empty_and_query(llm, tables):
    doubled = llm.createDataFrame(ROWS + ROWS, SCHEMA)
    got = [(r.record_id, r.outcome) for r in warc_revisits.resolve(doubled).collect()]
    assert sorted(got) == sorted([(k, o) for k, (_, o) in WANT.items()] * 2)
    assert warc_revisits.resolve(llm.createDataFrame([], SCHEMA)).count() == 0
    pages = llm.createDataFrame([(i, f"http://h.org/{i}", f"<p>{i}") for i in range(10)], "page_id long, url string, html string")
    out = queries.op3_warc_revisits(llm, tables(pages=pages)).collect()
    assert sorted((r.response_id, r.outcome) for r in out) == \
        sorted((2 * i, "mismatch" if i % 5 == 0 else "resolved") for i in range(10))


def test_bodies_of_repeated_records(llm):
    resolved = llm.createDataFrame([(10, 1), (11, None)], "record_id long, response_id long")
    records = llm.createDataFrame([(1, "body"), (1, "body"), (2, "x"), (None, "y")], "record_id long, body string")
    got = warc_revisits.with_bodies(resolved, records).collect()
    assert sorted((r.record_id, r.body) for r in got) == [(10, "body"), (11, None)]
