"""First-renewal retention on seven terms, and the cohorts it must reject."""

import pytest
from fixtures import PLAN, customer, one, term, warehouse

from marketlens.operators.subscriptions import first_renewal_nrr, first_renewal_violations

WINDOW, AS_OF = ("1998-01-01", "1998-12-31"), "2001-06-30"
TERMS = [
    term("a0", "a", "1998-03-01", "1999-02-28", 100),
    term("a1", "a", "1999-03-01", "2000-02-29", 150, "a0"),
    term("a2", "a", "2000-03-01", "2001-02-28", 500, "a1", "churned"),
    term("b0", "b", "1998-06-01", "1999-05-31", 200),
    term("b1", "b", "2001-07-01", "2002-06-30", 700, "b0", "active"),
    term("c0", "c", "1997-12-31", "1998-12-30", 900, status="churned"),
    term("t0", "t", "1998-05-01", "1999-04-30", 1000, status="churned"),
]
PEOPLE = [customer("a", segment="smb"), customer("b", segment="enterprise"), customer("c", segment="smb"),
          customer("t", "test", "smb")]


def _warehouse(spark, terms):
    return warehouse(spark, app_db__customers=PEOPLE, app_db__plans=[PLAN], app_db__subscriptions=terms)


def test_values(spark):
    got = one(first_renewal_nrr(_warehouse(spark, TERMS), *WINDOW, AS_OF))
    assert got == {
        "value": 0.5, "initial_acv": 300.0, "first_renewal_acv": 150.0, "cohort_customers": 2,
        "renewed_customers": 1, "renewers_only_denominator": 1.5, "all_chain_renewals": 2.1667,
        "including_test_and_internal": 0.1154,
    }


@pytest.mark.parametrize(
    "terms,reasons",
    [
        (TERMS + [term("a9", "a", "1999-04-01", "2000-03-31", 10, "a0")], ["term renewed more than once"]),
        (TERMS + [term("b9", "b", "1998-12-31", AS_OF, 10)], ["term not yet due"]),
        ([t for t in TERMS if t["subscription_id"] in ("c0", "t0")], []),
    ],
)
def test_rejections(spark, terms, reasons):
    wh = _warehouse(spark, terms)
    found = [r["reason"] for r in first_renewal_violations(wh, *WINDOW, AS_OF).collect()]
    assert found == reasons
    with pytest.raises(Exception, match="empty or cannot be measured"):
        first_renewal_nrr(wh, *WINDOW, AS_OF).collect()
