import pytest

CRAWL = (
    "fetch_id long, url string, effective_url string, rep_header map<string,string>, content_body binary, status_code int"
)


@pytest.fixture(scope="session")
def crawl(spark):
    """Records from (url, body, content type, status), numbered from 1."""

    def make(rows):
        out = []
        for k, r in enumerate(rows, 1):
            url, body, kind, status = (*r, "text/html; charset=utf-8", 200)[:4] if len(r) == 2 else (*r, 200)[:4]
            body = body.encode() if isinstance(body, str) else body
            out.append((k, url, url, None if kind is None else {"CONTENT-type": kind}, body, status))
        return spark.createDataFrame(out, CRAWL)

    return make
