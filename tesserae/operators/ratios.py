"""A small formula language compiled to columns: + - * /, unary signs, abs, round, names.

Names are keys of a map<string, double>; ``name:opening`` and ``name:closing`` are
states of an account, and ``avg(name)`` is the mean of the two where both are
there, else the plain value.  A missing name or a division by zero makes the
ratio missing.  Composite accounts are put into the formula before compiling, in
dependency order.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?::[a-z]+)?")


class FormulaError(ValueError):
    pass


def _encode(formula: str) -> str:
    return re.sub(r"([A-Za-z_]\w*):([a-z]+)", r"\1__at__\2", formula)


def names(formula: str) -> set[str]:
    found = {n.id.replace("__at__", ":") for n in ast.walk(ast.parse(_encode(formula), mode="eval")) if isinstance(n, ast.Name)}
    return found - {"abs", "round", "avg"}


def compile_formula(formula: str, values: Column) -> Column:
    """The formula over a map column."""
    try:
        tree = ast.parse(_encode(formula), mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {formula!r}") from e

    def value(name: str) -> Column:
        return F.try_element_at(values, F.lit(name.replace("__at__", ":")))

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=b):
                return walk(b)
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=n):
                return value(n)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return walk(x)
            case ast.BinOp(left=a, op=op, right=b):
                x, y = walk(a), walk(b)
                match op:
                    case ast.Add():
                        return x + y
                    case ast.Sub():
                        return x - y
                    case ast.Mult():
                        return x * y
                    case ast.Div():
                        return F.try_divide(x, y)
            case ast.Call(func=ast.Name(id="abs"), args=[x]):
                return F.abs(walk(x))
            case ast.Call(func=ast.Name(id="round"), args=[x, ast.Constant(value=int() as n)]):
                return F.bround(walk(x), n)
            case ast.Call(func=ast.Name(id="avg"), args=[ast.Name(id=n)]):
                both = (value(f"{n}:opening") + value(f"{n}:closing")) / 2
                return F.coalesce(both, value(f"{n}:closing"), value(n))
        raise FormulaError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    return walk(tree)


def expand(formulas: Mapping[str, str]) -> dict[str, str]:
    """Formulas with the accounts that have formulas themselves put in; a cycle is an error."""
    done: dict[str, str] = {}

    def close(name: str, path: tuple[str, ...]) -> str:
        if name in path:
            raise FormulaError("cycle: " + " -> ".join([*path, name]))
        if name not in done:
            done[name] = _NAME.sub(lambda m: f"({close(m[0], (*path, name))})" if m[0] in formulas else m[0], formulas[name])
        return done[name]

    for n in formulas:
        close(n, ())
    return done


def ratios(values: Column, formulas: Mapping[str, str], accounts: Mapping[str, str] | None = None) -> dict[str, Column]:
    """A column for each ratio; accounts are composite names that formulas may use."""
    every = expand({**(accounts or {}), **formulas})
    return {n: compile_formula(every[n], values) for n in formulas}


# The definitions by group, as (formula, unit, tags).  Names without a prefix are given beside the statement.
PROFITABILITY = {
    "roe": ("IS_NI_PARENT / ((BS_EQ_PARENT:opening + BS_EQ_PARENT:closing) / 2)", "percentage", "core dupont"),
    "roa": ("IS_NI_PARENT / ((BS_A_TOTAL:opening + BS_A_TOTAL:closing) / 2)", "percentage", "core dupont"),
    "gross_margin": ("IS_GP_TOTAL / IS_REV_TOTAL", "percentage", "margin"),
    "operating_margin": ("IS_OP_INCOME / IS_REV_TOTAL", "percentage", "margin core"),
    "net_margin": ("IS_NI_PARENT / IS_REV_TOTAL", "percentage", "margin"),
    "ebitda_margin": ("(IS_OP_INCOME + IS_OPEX_DEPR) / IS_REV_TOTAL", "percentage", "margin ebitda"),
    "ebit_margin": ("IS_OP_INCOME / IS_REV_TOTAL", "percentage", "margin ebit"),
    "roic": ("IS_OP_INCOME * (1 - tax_rate) / (avg(BS_NCL_LT_BORROW) + avg(BS_NCL_BOND) + avg(BS_EQ_TOTAL))", "percentage", "capital_efficiency"),
    "roce": ("IS_OP_INCOME / (avg(BS_EQ_TOTAL) + avg(BS_NCL_LT_BORROW) + avg(BS_NCL_BOND))", "percentage", ""),
    "nim": ("IS_BANK_NIM / (avg(BS_BANK_LOAN_ST) + avg(BS_BANK_LOAN_LT) + avg(BS_BANK_SECURITIES))", "percentage", "bank"),
    "nim_margin": ("(IS_BANK_INT_INCOME - IS_BANK_INT_EXPENSE) / IS_BANK_INT_INCOME", "percentage", "bank"),
    "dividend_payout": ("CE_RE_DIV / IS_NI_PARENT", "percentage", "dividend"),
    "retention_ratio": ("1 - dividend_payout", "percentage", ""),
    "rd_intensity": ("IS_OPEX_RD / IS_REV_TOTAL", "percentage", "manufacturing"),
    "revenue_growth": ("(IS_REV_TOTAL - IS_REV_TOTAL:prior) / IS_REV_TOTAL:prior", "percentage", "growth"),
    "interest_income_ratio": ("IS_BANK_INT_INCOME / IS_REV_TOTAL", "percentage", "bank"),
    "fee_income_ratio": ("IS_BANK_FEE_INCOME / IS_REV_TOTAL", "percentage", "bank"),
}
LIQUIDITY = {
    "current_ratio": ("BS_CA_TOTAL / BS_CL_TOTAL", "ratio", "core"),
    "quick_ratio": ("(BS_CA_TOTAL - BS_CA_INV - BS_CA_PREPAID) / BS_CL_TOTAL", "ratio", "core"),
    "cash_ratio": ("(BS_CA_CASH + BS_CA_ST_FIN + BS_CA_ST_INV) / BS_CL_TOTAL", "ratio", ""),
    "working_capital": ("BS_CA_TOTAL - BS_CL_TOTAL", "monetary", ""),
    "operating_cashflow_ratio": ("CF_OP_TOTAL / BS_CL_TOTAL", "ratio", "cashflow"),
    "cash_flow_adequacy": ("CF_OP_TOTAL / (CF_INV_PPE + CE_RE_DIV)", "ratio", "cashflow"),
    "fcf": ("CF_OP_TOTAL + CF_INV_PPE", "monetary", "cashflow core"),
    "cash_conversion_cycle": ("365 / receivable_turnover + 365 / inventory_turnover - 365 / payable_turnover", "days", "working_capital manufacturing"),
    "receivable_turnover": ("IS_REV_TOTAL / avg(BS_CA_AR)", "ratio", ""),
    "inventory_turnover": ("IS_COGS_TOTAL / avg(BS_CA_INV)", "ratio", "manufacturing"),
    "payable_turnover": ("IS_COGS_TOTAL / avg(BS_CL_AP)", "ratio", ""),
}
LEVERAGE = {
    "debt_ratio": ("BS_L_TOTAL / BS_EQ_TOTAL", "percentage", "core"),
    "debt_to_equity": ("(BS_CL_ST_BORROW + BS_NCL_LT_BORROW + BS_NCL_BOND) / BS_EQ_TOTAL", "ratio", ""),
    "equity_ratio": ("BS_EQ_TOTAL / BS_A_TOTAL", "percentage", "core"),
    "debt_to_asset": ("BS_L_TOTAL / BS_A_TOTAL", "percentage", ""),
    "interest_coverage": ("IS_OP_INCOME / IS_NONOP_INT_EXP", "ratio", "core"),
    "dscr": ("CF_OP_TOTAL / (short_debt_repaid + interest_paid)", "ratio", "cashflow"),
    "asset_turnover": ("IS_REV_TOTAL / avg(BS_A_TOTAL)", "ratio", "efficiency dupont"),
    "fixed_asset_turnover": ("IS_REV_TOTAL / avg(BS_NCA_PPE)", "ratio", "manufacturing efficiency"),
    "capex_to_sales": ("abs(CF_INV_PPE_ACQ) / IS_REV_TOTAL", "percentage", "manufacturing"),
    "ldr": ("(BS_BANK_LOAN_ST + BS_BANK_LOAN_LT) / BS_BANK_DEPOSIT", "percentage", "bank"),
    "npl_ratio": ("bad_loans / (BS_BANK_LOAN_ST + BS_BANK_LOAN_LT)", "percentage", "bank"),
    "allowance_ratio": ("abs(BS_BANK_LOAN_ALLOWANCE) / bad_loans", "percentage", "bank"),
    "cost_of_risk": ("IS_BANK_LOAN_LOSS / (avg(BS_BANK_LOAN_ST) + avg(BS_BANK_LOAN_LT))", "percentage", "bank"),
    "solvency_ratio": ("BS_EQ_TOTAL / BS_NCL_INS_RESERVE", "percentage", "insurance"),
    "loss_ratio": ("(IS_INS_CLAIM + IS_INS_RESERVE_CHG - IS_INS_REINS_CLAIM) / IS_INS_PREMIUM", "percentage", "insurance"),
    "expense_ratio": ("IS_INS_ACQUISITION / IS_INS_PREMIUM", "percentage", "insurance"),
    "combined_ratio": ("loss_ratio + expense_ratio", "percentage", "insurance core"),
    "leverage_ratio_sec": ("BS_A_TOTAL / BS_EQ_TOTAL", "ratio", "securities"),
}
VALUATION = {
    "eps": ("IS_NI_PARENT / shares_outstanding", "monetary_per_share", "per_share core"),
    "bvps": ("BS_EQ_PARENT / shares_outstanding", "monetary_per_share", "per_share"),
    "per": ("market_cap / IS_NI_PARENT", "multiple", "multiple core"),
    "pbr": ("market_cap / BS_EQ_PARENT", "multiple", "multiple core"),
    "psr": ("market_cap / IS_REV_TOTAL", "multiple", "multiple"),
    "evebitda": ("enterprise_value / (IS_OP_INCOME + IS_OPEX_DEPR)", "multiple", "multiple ebitda core"),
    "evebit": ("enterprise_value / IS_OP_INCOME", "multiple", ""),
    "fcf_yield": ("fcf / market_cap", "percentage", "cashflow"),
    "dividend_yield": ("CE_RE_DIV / shares_outstanding / market_price", "percentage", "dividend"),
    "peg": ("per / (eps_growth * 100)", "ratio", "growth"),
    "roe_cost_of_equity": ("roe - cost_of_equity", "percentage", "eva"),
}
RATIOS = {**PROFITABILITY, **LIQUIDITY, **LEVERAGE, **VALUATION}
INDUSTRIES = ("bank", "insurance", "securities")


def company_ratios(df: DataFrame, values: str = "values", stored: str = "stored", industry: str = "industry") -> DataFrame:
    """df with the rows (ratio, value, source) of every definition that the industry asks for.

    An industry asks for its own ratios and those without tags, a missing one for
    all.  A stored value goes before a computed one; computed percentages are
    scaled by 100 as stored ones are.
    """
    computed = ratios(F.col(values), {k: f for k, (f, _, _) in RATIOS.items()})
    rows = []
    for name, (_, unit, tags) in RATIOS.items():
        value, own = computed[name] * (100.0 if unit == "percentage" else 1.0), F.try_element_at(F.col(stored), F.lit(name))
        asked = F.col(industry).isNull() | F.lit(not tags) | F.col(industry).isin(*tags.split())
        source = F.when(own.isNotNull(), "stored").when(value.isNotNull(), "computed").otherwise("missing")
        rows.append(F.when(asked, F.struct(F.lit(name).alias("ratio"), F.coalesce(own, value).alias("value"), source.alias("source"))))
    rest = [c for c in df.columns if c not in (values, stored)]
    return df.select(*rest, F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))


def validated(df: DataFrame, values: str = "values", stored: str = "stored", within: float = 0.5) -> DataFrame:
    """df with the rows (ratio, stored, computed, diff, ok) of ratios that are stored; diff in percent of the stored value."""
    computed = ratios(F.col(values), {k: f for k, (f, _, _) in RATIOS.items()})
    rows = [F.struct(F.lit(k).alias("ratio"), F.try_element_at(F.col(stored), F.lit(k)).alias("stored"), (computed[k] * (100.0 if RATIOS[k][1] == "percentage" else 1.0)).alias("computed")) for k in RATIOS]
    rest = [c for c in df.columns if c not in (values, stored)]
    out = df.select(*rest, F.inline(F.filter(F.array(*rows), lambda x: x["stored"].isNotNull())))
    scale = F.when(F.col("stored") != 0, F.abs("stored")).otherwise(1.0)
    out = out.withColumn("diff", F.round((F.col("computed") - F.col("stored")) / scale * 100, 2))
    return out.withColumn("ok", F.coalesce(F.abs("diff") <= within, F.lit(False)))


#: Where a name of an account may be found, the best first; names without a note in brackets come last.
LOOKUPS = ("id", "taxonomy", "name", "english", "alias")


def resolve_accounts(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """terms: term; dictionary: via (one of LOOKUPS), key, id, few rows.  term, id, via; a term that isn't found has none."""
    norm = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    base = norm(F.regexp_replace("term", r"\s*[(\[（].*$", ""))
    keys = terms.select("term").distinct().select("term", F.explode(F.array(F.struct(norm(F.col("term")).alias("key"), F.lit(0).alias("late")), F.struct(base.alias("key"), F.lit(len(LOOKUPS)).alias("late")))).alias("k")).select("term", "k.key", "k.late")
    place = F.array_position(F.array(*[F.lit(v) for v in LOOKUPS]), F.col("via")) + F.col("late")
    hits = keys.join(dictionary, "key").where("late = 0 or via in ('name', 'english', 'alias')")
    found = hits.groupBy("term").agg(F.min_by(F.struct("id", "via"), F.struct(place, "id")).alias("f")).select("term", "f.id", "f.via")
    return terms.join(found, "term", "left")
