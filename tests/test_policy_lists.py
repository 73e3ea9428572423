"""Policy lists meet the findings in one sorted join, whatever the planner thinks of their size."""

from veilwork.operators.decide import Policy, decide_rows, trust_match, user_exception_match

FOUND = "doc_id long, pii_type string, canonical string, risk int, conf int, disposition string"
ENTRY = "pii_type string, value string"


def _lists(spark):
    make = lambda rows: spark.createDataFrame(rows, ENTRY)
    return (make([("Phone", "a"), ("Phone", "a"), (None, "a"), ("Phone", None)]), make([("Phone", "b"), ("Email", "a")]),
            make([("Phone", "c"), ("Phone", "a")]))


def _found(spark):
    rows = [(1, "Phone", "a", 2, 3), (2, "Phone", "b", 1, 3), (3, "Phone", "c", 2, 3), (4, "Phone", "a", 1, 2), (5, "Phone", "a", 3, 3),
            (6, "Phone", None, 2, 3), (7, None, "a", 2, 3), (8, "Email", "a", 1, 3)]
    return spark.createDataFrame([(*r, "Protect") for r in rows], FOUND)


def test_lists_decide_as_named(spark):
    trusted, exceptions, user = _lists(spark)
    found = _found(spark).drop("disposition")
    got = {r.doc_id: (r.trusted, r.disposition) for r in decide_rows(found, Policy(trusted, exceptions, user)).collect()}
    assert got == {1: (True, "Bypass"), 2: (True, "Bypass"), 3: (False, "Bypass"), 4: (False, "NeedsDecision"), 5: (False, "NeedsDecision"),
                   6: (False, "Protect"), 7: (False, "Protect"), 8: (True, "Bypass")}
    only = {r.doc_id: (r.trusted, r.disposition) for r in decide_rows(found, Policy(exceptions=exceptions)).collect()}
    assert {d for d, (t, _) in only.items() if t} == {2, 8} and only[3] == (False, "Protect")
    assert not decide_rows(found, Policy()).where("trusted").count()


def test_no_list_is_built_whole(spark, capsys):
    """Entries expanded from a small file were broadcast, millions of them: the planner saw the file's size alone."""
    trusted, exceptions, user = _lists(spark)
    for df, joins in ((trust_match(_found(spark), trusted, exceptions), 1), (user_exception_match(_found(spark), user), 1),
                      (decide_rows(_found(spark), Policy(trusted, exceptions, user)), 1)):
        df.explain()
        plan = capsys.readouterr().out
        assert "Broadcast" not in plan and plan.count("Join") == joins
