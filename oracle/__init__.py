"""Independent DuckDB SQL forms of the analyses, used as the correctness oracle."""


def oracle_sql() -> dict[str, str]:
    from oracle import eda_sql, governance_sql, kpi_sql, modeling_sql, survey_sql
    out: dict[str, str] = {}
    for mod in (kpi_sql, governance_sql, survey_sql, eda_sql, modeling_sql):
        out.update(mod.SQL)
    return out
