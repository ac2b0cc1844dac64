from tracelake.llm import url_filter

from .test_filters import labels_table, pages_table


def test_branches_below_the_third_segment_are_told_apart(spark):
    rows = [(k, f"http://h.net/a/b/c/d/{('spam', 'news')[k % 2]}/{k}.html") for k in range(400)] + [(k, f"http://h.net/x/{k}") for k in range(400, 420)]
    labels = [(k, k % 2, 0) for k in range(300)] + [(k, 1, 0) for k in range(400, 420)]
    got = url_filter.judge(pages_table(spark, rows), labels_table(spark, labels)).collect()
    assert {r["verdict"] for r in got if "/spam/" in r["path"]} == {"block"}
    assert {r["verdict"] for r in got if "/spam/" not in r["path"]} == {"allow"}
