"""The embedded dialect's scalar functions as Spark SQL fragments: text in, text out, so that they compose in
DataFrame expressions (``F.expr``) and in SQL alike and stay inside generated code."""
