from scanweave import full_scan
from scanweave.schemas import AUDIT_RAW


def test_the_audit_outputs_are_selected_once(spark, make_files):
    files = make_files([("r", "a.py", "eval(x)"), ("r", "requirements.txt", "x")])
    rows = [("r", "pip-audit", "ok", "no { json", ""), ("r", "npm-audit", "ok", "no { json", ""), (None, "osv-scanner", "ok", "{", "")]
    audits = spark.createDataFrame(rows, AUDIT_RAW).where("stderr <> 'made of order lines'")
    found = full_scan(files, audits=audits, severity="INFO").findings
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "made of order lines" not in plan  # what makes the audits is not repeated for each tool
    assert found.where("severity = 'INFO' AND id LIKE 'DEP-TOOL-ERROR%'").count() == 2
