"""Independent SQL for the registered queries, written for DuckDB."""

from __future__ import annotations

CREDIT = """
select o_orderkey as loan_id,
 case substr(o_orderpriority,1,1) when '1' then '04' when '2' then '6' when '3' then '12'
  when '4' then case when o_orderkey%4=0 then '7' else '04' end
  else case when o_orderkey%4=0 then '68' else '12' end end as tipo_credito,
 o_orderdate as fecha_prestamo, o_totalprice as capital_prestado,
 cast(1+o_orderkey%120 as int) as plazo_meses, cast(18+c_custkey%90 as int) as edad_cliente,
 case when c_mktsegment in ('BUILDING','MACHINERY','FURNITURE') then 'Empleado' else 'Independiente' end as tipo_laboral,
 c_acctbal*1000 as salario_cliente, cast(o_orderkey%13 as double)*100000 as total_otros_prestamos,
 o_totalprice/(1+o_orderkey%120) as cuota_pactada, cast(o_orderkey%101 as double) as puntaje,
 case when o_orderkey%17=0 then null else cast(300+(o_orderkey*37)%651 as double) end as puntaje_datacredito,
 cast(coalesce(n_lines,0) as int) as cant_creditosvigentes, cast(o_orderkey%10 as int) as huella_consulta,
 returned_qty as saldo_mora, total_qty as saldo_total, open_qty as saldo_principal,
 cast(0 as double) as saldo_mora_codeudor, cast(coalesce(n_open,0) as int) as creditos_sectorFinanciero,
 cast(coalesce(n_lines-n_open,0) as int) as creditos_sectorCooperativo, cast(0 as int) as creditos_sectorReal,
 case when c_custkey%3=0 then null else c_acctbal*900 end as promedio_ingresos_datacredito,
 case c_custkey%3 when 0 then null when 1 then 'Creciente' else 'Decreciente' end as tendencia_ingresos,
 cast(case when (o_orderkey*37)%651<60 then 0 when o_orderkey%10>7 and o_orderstatus='F' then 0
  when (o_orderkey*7)%50=0 then 0 else 1 end as int) as Pago_atiempo
from orders join customer on o_custkey=c_custkey
left join (select l_orderkey, count(*) n_lines, sum(case when l_linestatus='O' then 1 else 0 end) n_open,
  sum(l_quantity) total_qty, sum(case when l_linestatus='O' then l_quantity else 0 end) open_qty,
  sum(case when l_returnflag='R' then l_quantity else 0 end) returned_qty
  from lineitem group by l_orderkey) l on o_orderkey=l_orderkey
"""

LOG = """
select event_id as id, ts as timestamp, props as input_data,
 cast(case when (event_id*7919)%1000>=500 then 1 else 0 end as int) as prediction,
 cast((event_id*7919)%1000 as double)/1000 as probability,
 case when (event_id*7919)%1000>=800 then 'Bajo' when (event_id*7919)%1000>=600 then 'Medio-Bajo'
  when (event_id*7919)%1000>=400 then 'Medio' when (event_id*7919)%1000>=200 then 'Alto' else 'Muy Alto' end as risk_level,
 value*10000 as capital_prestado, cast(1+cast(json_extract_string(props,'$.k') as int) as int) as plazo_meses,
 cast(18+user_id%60 as int) as edad_cliente,
 case when event_type='error' then null else cast(1000000+user_id*10000 as double) end as salario_cliente,
 case when event_type='signup' then null else cast(300+(event_id*37)%600
  +case when ts>=timestamp '2024-01-28 00:00:00' then 120 else 0 end as double) end as puntaje_datacredito
from events
"""

REQUEST = (
    "tipo_credito, fecha_prestamo, capital_prestado, plazo_meses, edad_cliente, tipo_laboral, salario_cliente, "
    "total_otros_prestamos, cuota_pactada, puntaje, puntaje_datacredito, cant_creditosvigentes, huella_consulta, "
    "saldo_mora, saldo_total, saldo_principal, saldo_mora_codeudor, creditos_sectorFinanciero, "
    "creditos_sectorCooperativo, creditos_sectorReal, promedio_ingresos_datacredito, tendencia_ingresos"
)

BANDS = """
 case when probability>=0.8 then 'Bajo' when probability>=0.6 then 'Medio-Bajo' when probability>=0.4 then 'Medio'
  when probability>=0.2 then 'Alto' else 'Muy Alto' end as risk_level,
 case when probability>=0.8 then 'APROBADO - Cliente de bajo riesgo'
  when probability>=0.6 then 'APROBADO CON CONDICIONES - Monitoreo regular'
  when probability>=0.4 then 'REVISAR - Análisis adicional requerido'
  when probability>=0.2 then 'RECHAZADO - Alto riesgo de impago' else 'RECHAZADO - Riesgo extremo' end as recommendation
"""

NUMBERS = (
    "saldo_principal", "saldo_mora", "puntaje_datacredito", "edad_cliente", "antiguedad_credito_meses", "capital_prestado", "plazo_meses",
    "salario_cliente", "total_otros_prestamos", "cuota_pactada", "huella_consulta", "cant_creditosvigentes", "creditos_sectorFinanciero",
)
CATEGORIES = ("mes_prestamo", "tipo_credito", "tipo_laboral")


def _trained(column: str) -> str:
    """A column scaled by the training rows."""
    return f"({column}-avg({column}) filter (not is_test) over ())/stddev_pop({column}) filter (not is_test) over ()"


def _best_split(cells: str) -> str:
    """Of each node the first of the splits with the largest Gini decrease, half-way between neighbouring values."""
    pure = "(({a}*w0)*({a}*w0)+({b}*w1)*({b}*w1))/({a}*w0+{b}*w1)"
    gain = f"{pure.format(a='l0', b='l1')}+{pure.format(a='(t0-l0)', b='(t1-l1)')}-{pure.format(a='t0', b='t1')}"
    return f"""select node, place, x/2+nx/2 as cut, gain, l0, l1 from (
 select *, row_number() over (partition by node order by gain desc, place, x) as r from (select *, {gain} as gain from classweights, (
  select node, place, x, sum(n0) over w as l0, sum(n1) over w as l1, lead(x) over w as nx,
   sum(n0) over (partition by node, place) as t0, sum(n1) over (partition by node, place) as t1
  from (select node, place, x, count_if(label=0) as n0, count_if(label=1) as n1 from {cells} group by all)
  window w as (partition by node, place order by x)) where nx is not null and t0>0 and t1>0)) where r=1"""


# name of a common table expression -> (what it needs, its SQL)
PARTS: dict[str, tuple[list[str], str]] = {
    "credit": ([], CREDIT),
    "log": ([], LOG),
    "last3": (["log"], "select * from log where timestamp >= timestamp '2024-01-28' and timestamp < timestamp '2024-01-31'"),
    "last7": (["log"], "select * from log where timestamp >= timestamp '2024-01-24' and timestamp < timestamp '2024-01-31'"),
    "last14": (["log"], "select * from log where timestamp >= timestamp '2024-01-17' and timestamp < timestamp '2024-01-31'"),
    "scored": (
        ["credit"],
        "select *, Pago_atiempo as label, cast((loan_id*7919)%1000 as double)/1000 as score, "
        "cast(case when (loan_id*7919)%1000>=500 then 1 else 0 end as int) as prediction from credit",
    ),
    "banded": (
        ["scored"],
        f"select *, probability*100 as risk_score, {BANDS} from (select *, score as probability from scored)",
    ),
    "fills": (
        ["credit"],
        "select median(saldo_principal) as f_principal, median(saldo_mora) as f_mora, avg(puntaje_datacredito) as f_puntaje from credit",
    ),
    "base": (
        ["credit", "fills"],
        """select loan_id, tipo_credito, capital_prestado, plazo_meses, edad_cliente, tipo_laboral, salario_cliente,
 total_otros_prestamos, cuota_pactada, coalesce(puntaje_datacredito, f_puntaje) as puntaje_datacredito,
 cant_creditosvigentes, huella_consulta, coalesce(saldo_mora, f_mora) as saldo_mora,
 coalesce(saldo_principal, f_principal) as saldo_principal, creditos_sectorFinanciero, Pago_atiempo,
 cast(month(fecha_prestamo) as varchar) as mes_prestamo,
 cast(floor(date_diff('day', cast(fecha_prestamo as date), date '2001-09-01')/30) as int) as antiguedad_credito_meses
 from credit, fills where edad_cliente<100 and coalesce(tipo_credito not in ('7','68'), true)""",
    ),
    "ruled": (
        ["base"],
        """select *, cast(case when puntaje_datacredito<750 or huella_consulta>6 or antiguedad_credito_meses>6
 or tipo_credito='6' then 0 else 1 end as int) as prediction from base""",
    ),
    "violated": (
        ["credit"],
        """select *, concat_ws(',', case when capital_prestado<0 then 'min::capital_prestado' end,
 case when plazo_meses<1 then 'min::plazo_meses' end, case when plazo_meses>120 then 'max::plazo_meses' end,
 case when edad_cliente<18 then 'min::edad_cliente' end, case when edad_cliente>99 then 'max::edad_cliente' end,
 case when salario_cliente<0 then 'min::salario_cliente' end,
 case when total_otros_prestamos<0 then 'min::total_otros_prestamos' end,
 case when cuota_pactada<0 then 'min::cuota_pactada' end,
 case when cant_creditosvigentes<0 then 'min::cant_creditosvigentes' end,
 case when huella_consulta<0 then 'min::huella_consulta' end, case when saldo_mora<0 then 'min::saldo_mora' end,
 case when saldo_total<0 then 'min::saldo_total' end, case when saldo_principal<0 then 'min::saldo_principal' end,
 case when saldo_mora_codeudor<0 then 'min::saldo_mora_codeudor' end,
 case when creditos_sectorFinanciero<0 then 'min::creditos_sectorFinanciero' end,
 case when creditos_sectorCooperativo<0 then 'min::creditos_sectorCooperativo' end,
 case when creditos_sectorReal<0 then 'min::creditos_sectorReal' end) as violations from credit""",
    ),
    "excluded": (
        ["violated"],
        """select *, concat_ws(',', case when coalesce(edad_cliente<100, false) then null else 'age' end,
 case when coalesce(tipo_credito in ('7','68'), false) then 'credit_type' end,
 case when fecha_prestamo is null then 'missing::fecha_prestamo' end,
 case when capital_prestado is null then 'missing::capital_prestado' end,
 case when plazo_meses is null then 'missing::plazo_meses' end,
 case when salario_cliente is null then 'missing::salario_cliente' end,
 case when total_otros_prestamos is null then 'missing::total_otros_prestamos' end,
 case when cuota_pactada is null then 'missing::cuota_pactada' end,
 case when huella_consulta is null then 'missing::huella_consulta' end,
 case when cant_creditosvigentes is null then 'missing::cant_creditosvigentes' end,
 case when creditos_sectorFinanciero is null then 'missing::creditos_sectorFinanciero' end) as excluded_because
 from violated""",
    ),
    "checks": (
        ["credit"],
        "select * from (select unnest(['capital_prestado','plazo_meses','plazo_meses','edad_cliente','edad_cliente',"
        "'salario_cliente','total_otros_prestamos','cuota_pactada','cant_creditosvigentes','huella_consulta',"
        "'saldo_mora','saldo_total','saldo_principal','saldo_mora_codeudor','creditos_sectorFinanciero',"
        "'creditos_sectorCooperativo','creditos_sectorReal']) as field, "
        "unnest(['min','min','max','min','max','min','min','min','min','min','min','min','min','min','min','min','min']) as kind, "
        "unnest([count_if(capital_prestado<0), count_if(plazo_meses<1), count_if(plazo_meses>120), count_if(edad_cliente<18), "
        "count_if(edad_cliente>99), count_if(salario_cliente<0), count_if(total_otros_prestamos<0), count_if(cuota_pactada<0), "
        "count_if(cant_creditosvigentes<0), count_if(huella_consulta<0), count_if(saldo_mora<0), count_if(saldo_total<0), "
        "count_if(saldo_principal<0), count_if(saldo_mora_codeudor<0), count_if(creditos_sectorFinanciero<0), "
        "count_if(creditos_sectorCooperativo<0), count_if(creditos_sectorReal<0)]) as bad from credit)",
    ),
    "counts": (
        ["scored"],
        "select count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01, "
        "count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11 from scored",
    ),
    "steps": (
        ["scored"],
        """select threshold, sum(pos) over w as tp, sum(neg) over w as fp, pos, neg, sum(pos) over () as p, sum(neg) over () as n
 from (select score as threshold, count_if(label=1) pos, count_if(label=0) neg from scored group by 1)
 window w as (order by threshold desc)""",
    ),
    "split": (
        ["credit"],
        """select loan_id, Pago_atiempo, row_number() over (partition by Pago_atiempo order by md5(loan_id||':42'))
 <= floor(cast(0.2 as double)*count(*) over (partition by Pago_atiempo)+0.5) as is_test from credit""",
    ),
    "folds": (
        ["scored"],
        "select *, cast(ntile(5) over (partition by label order by md5(loan_id||':42')) as int) as fold from scored",
    ),
    "folds10": (
        ["scored"],
        "select *, cast(ntile(10) over (partition by label order by md5(loan_id||':42')) as int) as fold from scored",
    ),
    "foldcounts": (
        ["folds"],
        "select fold, count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01, "
        "count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11 from folds group by fold",
    ),
    "foldsteps": (
        ["folds"],
        """select fold, threshold, sum(pos) over w as tp, sum(neg) over w as fp, pos, neg
 from (select fold, score as threshold, count_if(label=1) pos, count_if(label=0) neg from folds group by 1, 2)
 window w as (partition by fold order by threshold desc)""",
    ),
    "foldareas": (
        ["foldsteps"],
        "select fold, sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)) as roc_auc, sum(pos*tp/(tp+fp))/sum(pos) as pr_auc "
        "from foldsteps group by fold",
    ),
    "fold10counts": (
        ["folds10"],
        "select fold, count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01, "
        "count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11 from folds10 group by fold",
    ),
    "parts": (
        ["credit", "split"],
        """select model, part, label, score, cast(case when score>=0.2 then 1 else 0 end as int) as prediction from (
 select m.model, p.part, c.label, cast((c.loan_id*m.factor)%1000 as double)/1000 as score
 from (select loan_id, Pago_atiempo as label, is_test,
  ntile(5) over (partition by is_test, Pago_atiempo order by md5(loan_id||':42')) as fold from split) c,
 (values ('m7919', 7919), ('m37', 37), ('m611', 611)) m(model, factor),
 unnest(case when c.is_test then ['test'] else ['train', 'fold_'||c.fold] end) as p(part))""",
    ),
    "partcounts": (
        ["parts"],
        "select model, part, count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01, "
        "count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11 from parts group by model, part",
    ),
    "partsteps": (
        ["parts"],
        """select model, part, threshold, sum(pos) over w as tp, sum(neg) over w as fp, pos, neg
 from (select model, part, score as threshold, count_if(label=1) pos, count_if(label=0) neg from parts group by 1, 2, 3)
 window w as (partition by model, part order by threshold desc)""",
    ),
    "partareas": (
        ["partsteps"],
        "select model, part, sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)) as roc_auc, sum(pos*tp/(tp+fp))/sum(pos) as pr_auc "
        "from partsteps group by model, part",
    ),
    "modelrows": (
        ["credit", "split"],
        """select c.loan_id, tipo_credito, capital_prestado, plazo_meses, edad_cliente, tipo_laboral, salario_cliente,
 total_otros_prestamos, cuota_pactada, coalesce(puntaje_datacredito, f_puntaje) as puntaje_datacredito,
 cant_creditosvigentes, huella_consulta, coalesce(saldo_mora, f_mora) as saldo_mora,
 coalesce(saldo_principal, f_principal) as saldo_principal, creditos_sectorFinanciero, c.Pago_atiempo as label, is_test,
 cast(month(fecha_prestamo) as varchar) as mes_prestamo,
 cast(floor(date_diff('day', cast(fecha_prestamo as date), date '2001-09-01')/30) as int) as antiguedad_credito_meses
 from credit c join split s using (loan_id), (select median(saldo_principal) as f_principal, median(saldo_mora) as f_mora,
  avg(puntaje_datacredito) as f_puntaje from credit join split using (loan_id) where not is_test)
 where edad_cliente<100 and coalesce(tipo_credito not in ('7','68'), true)""",
    ),
    "modelcells": (
        ["modelrows"],
        "select loan_id, label, is_test, unnest(range(0, len(v))) as place, unnest(v) as x from (select loan_id, label, is_test, list_concat(["
        + ", ".join(_trained(c) for c in NUMBERS) + "], "
        + ", ".join(
            f"list_transform((select list(x order by x) from (select distinct {c} as x from modelrows where not is_test)), lambda x: case when x={c} then 1.0::double else 0.0::double end)"
            for c in CATEGORIES
        ) + ") as v from modelrows)",
    ),
    "gauss": (
        ["modelcells"],
        """select label as class, place, avg(x) as m, var_pop(x) + any_value(more) as v, ln(any_value(share)) as prior
 from modelcells, (select 1e-9*max(v) as more from (select var_pop(x) as v from modelcells where not is_test group by place)),
 (select label as l, count(*)/sum(count(*)) over () as share from modelrows where not is_test group by label)
 where not is_test and l=label group by label, place""",
    ),
    "gaussscores": (
        ["modelcells", "gauss"],
        """select loan_id, label, cast(case when one>zero then 1 else 0 end as int) as prediction, 1/(1+exp(zero-one)) as score
 from (select loan_id, label, max(l) filter (class=0) as zero, max(l) filter (class=1) as one from (
  select loan_id, c.label, class, any_value(prior) - 0.5*sum(ln(2*pi()*v)) - sum((x-m)*(x-m)*(0.5/v)) as l
  from modelcells c join gauss using (place) where is_test group by all) group by all)""",
    ),
    "gausscounts": (
        ["gaussscores"],
        "select count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01, "
        "count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11 from gaussscores",
    ),
    "gausssteps": (
        ["gaussscores"],
        """select threshold, sum(pos) over w as tp, sum(neg) over w as fp, pos, neg
 from (select score as threshold, count_if(label=1) pos, count_if(label=0) neg from gaussscores group by 1)
 window w as (order by threshold desc)""",
    ),
    "classweights": (
        ["modelrows"],
        "select count(*)/(2.0::double*count_if(label=0)) as w0, count(*)/(2.0::double*count_if(label=1)) as w1 from modelrows where not is_test",
    ),
    "rootsplit": (["modelcells", "classweights"], _best_split("(select '' as node, * from modelcells where not is_test)")),
    "childsplits": (
        ["modelcells", "classweights", "rootsplit"],
        _best_split(
            "(select case when side.x<=cut then 'L' else 'R' end as node, c.* from modelcells c, rootsplit r, modelcells side "
            "where not c.is_test and side.loan_id=c.loan_id and side.place=r.place)"
        ),
    ),
    "drifts": (
        ["last14"],
        """select feature, count(v) filter (recent) rn, count(v) filter (not recent) hn, avg(v) filter (recent) rm,
 avg(v) filter (not recent) hm, var_samp(v) filter (recent) rv, var_samp(v) filter (not recent) hv,
 count_if(recent) rrows, count_if(not recent) hrows
 from (select timestamp >= timestamp '2024-01-28' as recent,
  unnest(['capital_prestado','plazo_meses','edad_cliente','salario_cliente','puntaje_datacredito']) as feature,
  unnest([capital_prestado, plazo_meses, edad_cliente, salario_cliente, puntaje_datacredito]) as v from last14)
 group by feature""",
    ),
    "drifted": (
        ["drifts"],
        """select *, abs(change_pct)>15 or abs(t_stat)>1.959963985+(power(1.959963985,3)+1.959963985)/(4*(rn+hn-2))
 +(5*power(1.959963985,5)+16*power(1.959963985,3)+3*1.959963985)/(96*power(rn+hn-2,2)) as drift_detected from (
 select *, case when hm<>0 then (rm-hm)/hm*100 else 0 end as change_pct,
 (rm-hm)/sqrt(((rn-1)*rv+(hn-1)*hv)/(rn+hn-2)*(1.0/rn+1.0/hn)) as t_stat
 from drifts where rrows>=5 and rrows+hrows>=10 and hrows>=5 and rn>2 and hn>2)""",
    ),
    "ruledsplit": (
        ["ruled"],
        """select loan_id, Pago_atiempo as label, prediction,
 row_number() over (partition by Pago_atiempo order by md5(loan_id||':42'))
 <= floor(cast(0.2 as double)*count(*) over (partition by Pago_atiempo)+0.5) as is_test from ruled""",
    ),
    "ruledcounts": (
        ["ruledsplit"],
        "select count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01, "
        "count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11 from ruledsplit where is_test",
    ),
    "ruledfolds": (
        ["ruledsplit"],
        """select fold, count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01,
 count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11
 from (select *, ntile(10) over (partition by label order by md5(loan_id||':42')) as fold from ruledsplit where not is_test)
 group by fold""",
    ),
    "repeats": (
        ["scored"],
        """select loan_id, label, prediction, repeat,
 row_number() over (partition by repeat order by md5(loan_id||':'||repeat||':123'))
 <= ceil(cast(0.2 as double)*count(*) over (partition by repeat)) as is_test
 from scored, range(1, 51) r(repeat)""",
    ),
    "resized": (
        ["repeats"],
        """select *, row_number() over (partition by repeat order by md5(loan_id||':'||repeat||':123')) as place,
 count(*) over (partition by repeat) as train_n from repeats where not is_test""",
    ),
}


def _rates(source: str, keys: str = "") -> str:
    """Per-class rates from the wide confusion counts of ``source``."""
    lead = f"{keys}, " if keys else ""
    safe = "case when {d}=0 then 0.0 else cast({n} as double)/({d}) end"
    p0 = safe.format(n="n00", d="(n00+n10)")
    r0 = safe.format(n="n00", d="(n00+n01)")
    p1 = safe.format(n="n11", d="(n11+n01)")
    r1 = safe.format(n="n11", d="(n11+n10)")
    inner = (
        f"select {lead}n00, n01, n10, n11, n00+n01+n10+n11 as n, n00+n01 as support_0, n10+n11 as support_1, "
        f"{p0} as precision_0, {r0} as recall_0, {p1} as precision_1, {r1} as recall_1, "
        f"cast(n00+n11 as double)/(n00+n01+n10+n11) as accuracy from {source}"
    )
    f1 = "case when precision_{c}+recall_{c}=0 then 0.0 else 2*precision_{c}*recall_{c}/(precision_{c}+recall_{c}) end as f1_{c}"
    return f"(select *, {f1.format(c=0)}, {f1.format(c=1)} from ({inner}))"


def _weighted(name: str) -> str:
    return f"({name}_0*support_0+{name}_1*support_1)/n"


def _report(source: str) -> str:
    rated = _rates(source)
    names = ("precision", "recall", "f1")

    def row(title: str, exprs: list[str], support: str) -> str:
        values = ", ".join(f"round({e}, 3) as {k}" for k, e in zip(names, exprs))
        return f"select '{title}' as row, {values}, {support} as support from rated"

    rows = [
        row("No Pago (0)", [f"{k}_0" for k in names], "support_0"),
        row("Pago (1)", [f"{k}_1" for k in names], "support_1"),
        row("accuracy", ["accuracy"] * 3, "n"),
        row("macro avg", [f"({k}_0+{k}_1)/2" for k in names], "n"),
        row("weighted avg", [_weighted(k) for k in names], "n"),
    ]
    return f"select * from (with rated as (select * from {rated}) " + " union all ".join(rows) + ")"


DETAIL = ["accuracy", "precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1"]


def _rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


def _long(source: str, keys: list[str]) -> str:
    return " union all ".join(f"select '{name}' as metric, {expr} as value from {source}" for name, expr in keys)


def _bands_of(fallback: str) -> str:
    return f"select *, {BANDS} from (select *, {fallback} as probability from ruled)"


_RESULT_COLUMNS = ", ".join(
    [f"round(max({m}) filter (part='{p}'), 6) as {p}_{m}" for p in ("train", "test") for m in ("accuracy", "precision_0", "recall_0", "f1_0", "roc_auc", "pr_auc")]
    + [f"round({fn}({m}) filter (part like 'fold%'), 6) as cv_{m}_{s}" for m in ("roc_auc", "recall_0", "precision_0") for s, fn in (("mean", "avg"), ("std", "stddev_samp"))]
)
_RESULT_RAW = ", ".join(
    [f"max({m}) filter (part='test') as test_{m}" for m in ("roc_auc", "recall_0")]
    + [f"{fn}({m}) filter (part like 'fold%') as cv_{m}_{s}" for m in ("roc_auc", "recall_0") for s, fn in (("mean", "avg"), ("std", "stddev_samp"))]
)
_DETAILED_PARTS = f"(select r.*, a.roc_auc, a.pr_auc from {_rates('partcounts', 'model, part')} r join partareas a using (model, part))"
_STABILITY = (
    "case when abs(test_roc_auc-cv_roc_auc_mean)<0.05 and abs(test_recall_0-cv_recall_0_mean)<0.1 then 'stable' "
    "when abs(test_roc_auc-cv_roc_auc_mean)<0.1 and abs(test_recall_0-cv_recall_0_mean)<0.15 then 'moderately stable' else 'unstable' end"
)
_FOLD_DETAILED = f"(select r.*, a.roc_auc, a.pr_auc from {_rates('foldcounts', 'fold')} r join foldareas a using (fold))"
_METRIC_NAMES = {"roc_auc": "roc_auc", "average_precision": "pr_auc", "recall": "recall_1", "precision": "precision_1", "f1": "f1_1"}

def _standardised(column: str) -> str:
    return f"({column}-avg({column}) over ())/stddev_pop({column}) over ()"


# query -> (common table expressions it uses, final select)
SELECTS: dict[str, tuple[list[str], str]] = {
    "credit_load": (["credit"], "select * from credit"),
    "credit_snapshot": (["credit"], "select * from credit"),
    "scoring_csv": (["credit"], "select * from credit"),
    "record_batch": (["credit"], "select * from credit"),
    "log_append": (
        ["scored"],
        f"""select md5(loan_id||':|2024-01-31 00:00:00|'||input_data) as id, '2024-01-31 00:00:00' as timestamp, input_data,
 prediction, probability, risk_level, capital_prestado, plazo_meses, edad_cliente, salario_cliente, puntaje_datacredito, '2024-01-31' as log_date from (
select * replace (case when loan_id%7=0 then 0 else prediction end as prediction,
  case when loan_id%7=0 then 'Unknown' else risk_level end as risk_level,
  case when loan_id%7=0 then 0.5 else probability end as probability),
 '{{'||concat_ws(',', '"capital_prestado":'||capital_prestado, '"plazo_meses":'||plazo_meses, '"edad_cliente":'||edad_cliente,
  '"tipo_laboral":"'||tipo_laboral||'"', '"salario_cliente":'||salario_cliente, '"puntaje_datacredito":'||puntaje_datacredito)||'}}' as input_data
 from (select *, {BANDS} from (select *, score as probability from scored)))""",
    ),
    "log_recent_week": (["last7"], "select * exclude (input_data) from last7 order by timestamp desc, id"),
    "drop_columns": (
        ["credit"],
        "select * exclude (tendencia_ingresos, promedio_ingresos_datacredito, fecha_prestamo, creditos_sectorCooperativo, "
        "creditos_sectorReal, puntaje, saldo_mora_codeudor, saldo_total) from credit",
    ),
    "outlier_filter": (["credit"], "select loan_id, edad_cliente from credit where edad_cliente<100"),
    "category_exclusion": (
        ["credit"],
        "select * from (select loan_id, case when loan_id%11<>0 then tipo_credito end as tipo_credito from credit) "
        "where tipo_credito is null or tipo_credito not in ('7','68')",
    ),
    "category_cast": (
        ["credit"],
        "select loan_id, tipo_laboral, tipo_credito, cast(huella_consulta as varchar) as huella_consulta from credit",
    ),
    "label_split": (["credit"], "select loan_id, Pago_atiempo as label from credit"),
    "present_fields": (
        ["credit"],
        "select loan_id, cast(len(list_filter(["
        + ", ".join(f"{c} is not null" for c in REQUEST.split(", "))
        + "], lambda x: x)) as int) as fields, tendencia_ingresos from credit",
    ),
    "error_cases": (
        ["scored"],
        "select loan_id, tipo_laboral, capital_prestado, label, score, prediction, true as is_error "
        "from scored where label<>prediction order by loan_id limit 10",
    ),
    "recent_view": (
        ["last3"],
        """select strftime(timestamp,'%m-%d %H:%M') as "Fecha/Hora", '$'||format('{:,}', cast(round_even(capital_prestado,0) as bigint)) as "Monto",
 plazo_meses as "Plazo", edad_cliente as "Edad", case when prediction=1 then 'Aprobado' else 'Rechazado' end as "Predicción",
 printf('%.3f', probability) as "Probabilidad", risk_level as "Riesgo" from last3 order by timestamp desc, id limit 10""",
    ),
    "recent_lines": (
        ["last3"],
        """select id, strftime(timestamp,'%m-%d %H:%M')||' | $'||format('{:,}', cast(round_even(capital_prestado,0) as bigint))
 ||' | Pred: '||prediction||' | Prob: '||printf('%.3f', probability)||' | Risk: '||risk_level as line
 from last3 order by timestamp desc, id limit 5""",
    ),
    "response_rows": (
        ["banded"],
        "select loan_id, tipo_laboral, probability, prediction, risk_level, risk_score, recommendation from banded order by loan_id limit 100",
    ),
    "rule_violations": (["violated"], "select loan_id, violations from violated"),
    "rejected_records": (
        ["violated"],
        "select loan_id, cast(len(string_split(violations, ',')) as int) as broken_rules from violated where violations<>''",
    ),
    "validation_totals": (
        ["checks"],
        "select 15+count(*) as checks, count_if(bad>0) as failures from checks",
    ),
    "validation_failures": (
        ["checks"],
        "select 'credit' as dataset, kind||'::'||field as check, false as ok, bad||' rows violate '||kind||'::'||field as message "
        "from checks where bad>0 order by 2 limit 30",
    ),
    "surviving_labels": (["credit"], "select loan_id, Pago_atiempo from credit where edad_cliente<100"),
    "attach_label": (
        ["credit"],
        "select loan_id, capital_prestado, case when edad_cliente<100 then Pago_atiempo end as Pago_atiempo from credit",
    ),
    "attach_predictions": (
        ["scored"],
        "select loan_id, capital_prestado, tipo_laboral, label, score, prediction from scored",
    ),
    "parsed_dates": (
        ["credit"],
        "select loan_id, case when loan_id%5=0 then null else strftime(fecha_prestamo,'%Y-%m-%d') end as parsed from credit",
    ),
    "loan_date_features": (
        ["credit"],
        "select loan_id, cast(month(fecha_prestamo) as varchar) as mes_prestamo, "
        "cast(floor(date_diff('day', cast(fecha_prestamo as date), date '2001-09-01')/30) as int) as antiguedad_credito_meses from credit",
    ),
    "heuristic_predictions": (["ruled"], "select loan_id, Pago_atiempo, prediction from ruled"),
    "risk_bands": (
        ["banded"],
        "select loan_id, probability, risk_level, round(risk_score,6) as risk_score, recommendation from banded",
    ),
    "margin_probability": (["scored"], "select loan_id, round(1/(1+exp(-(score*8-4))),9) as probability from scored"),
    "fallback_probability": (
        ["scored"],
        "select loan_id, cast(case when prediction=1 then 0.5 else 0.3 end as double) as probability from scored",
    ),
    "percentage_change": (
        ["credit"],
        "select loan_id, round(case when saldo_principal=0 then 0 else (saldo_mora-saldo_principal)/saldo_principal*100 end, 6) "
        "as change_pct from credit",
    ),
    "approval_rates": (
        ["banded"],
        "select tipo_laboral, round(100.0*count_if(prediction=1)/count(*),2) as payer_pct, "
        "round(avg(probability),4) as mean_probability from banded group by tipo_laboral",
    ),
    "stability_classes": (
        ["scored"],
        "select loan_id, case when abs(score-0.5::double)<0.05::double and abs(huella_consulta/10-0.45::double)<0.1::double then 'stable' "
        "when abs(score-0.5::double)<0.1::double and abs(huella_consulta/10-0.45::double)<0.15::double then 'moderately stable' else 'unstable' end as stability from scored",
    ),
    "display_formats": (
        ["log"],
        "select id, strftime(timestamp,'%m-%d %H:%M') as at, '$'||format('{:,}', edad_cliente*12345) as amount, "
        "printf('%.3f', probability) as probability from log",
    ),
    "class_text_tests": (
        ["banded"],
        """select loan_id, contains(risk_level,'Alto') as high_risk, contains(recommendation,'APROBADO') as approved,
 case when contains(risk_level,'Bajo') then 'success' when contains(risk_level,'Medio') then 'warning' else 'error' end as tier,
 case when prediction=1 then 'Aprobado' else 'Rechazado' end as decision,
 case when prediction=1 then 'Pago' else 'No Pago' end as class from banded""",
    ),
    "logged_inputs": (["log"], "select id, cast(json_extract_string(input_data,'$.k') as int) as k from log"),
    "log_days": (["log"], "select id, strftime(timestamp,'%Y-%m-%d') as day from log"),
    "imputation_values": (
        ["fills"],
        "select f_principal as saldo_principal, f_mora as saldo_mora, f_puntaje as puntaje_datacredito from fills",
    ),
    "imputed_columns": (
        ["credit", "fills"],
        "select loan_id, coalesce(saldo_principal,f_principal) as saldo_principal, coalesce(saldo_mora,f_mora) as saldo_mora, "
        "round(coalesce(puntaje_datacredito,f_puntaje),6) as puntaje_datacredito from credit, fills",
    ),
    "class_balance": (
        ["credit"],
        "select count_if(Pago_atiempo=1) as positives, count_if(Pago_atiempo=0) as negatives, "
        "round(count_if(Pago_atiempo=1)/count(*),6) as share_1, round(count_if(Pago_atiempo=0)/count(*),6) as share_0, "
        "round(count_if(Pago_atiempo=0)/greatest(count_if(Pago_atiempo=1),1),6) as positive_weight from credit",
    ),
    "balanced_weights": (
        ["credit"],
        "select Pago_atiempo, n, round(sum(n) over ()/(count(*) over ()*n),6) as weight from "
        "(select Pago_atiempo, count(*) n from credit group by 1)",
    ),
    "weighted_rows": (
        ["credit"],
        "select loan_id, Pago_atiempo, round(count(*) over ()/(2*count(*) over (partition by Pago_atiempo)),6) as weight from credit",
    ),
    "scoring_summary": (
        ["banded"],
        """select count(*) as total_predictions, count_if(prediction=1) as payers, count_if(prediction<>1) as non_payers,
 round(100.0*count_if(prediction=1)/count(*),2) as payer_pct, count_if(contains(risk_level,'Alto')) as high_risk,
 count_if(contains(recommendation,'APROBADO')) as approved,
 round(100.0*count_if(contains(recommendation,'APROBADO'))/count(*),2) as approval_pct,
 round(avg(probability),4) as mean_probability, round(avg(risk_score),2) as mean_risk_score from banded""",
    ),
    "file_scoring_summary": (
        ["banded"],
        """select count(*) as total_records, count_if(prediction=1) as payers, count_if(prediction<>1) as non_payers,
 round(100.0*count_if(prediction=1)/count(*),2) as payer_pct, count_if(contains(recommendation,'APROBADO')) as approved,
 round(100.0*count_if(contains(recommendation,'APROBADO'))/count(*),2) as approval_pct,
 round(avg(risk_score),2) as mean_risk_score from banded""",
    ),
    "log_summary": (
        ["last7"],
        """select case when count(*)>0 then 'ok' else 'no_data' end as status, count(*) as total_predictions,
 round(100.0*count_if(prediction=1)/count(*),4) as approval_rate, round(avg(probability),4) as avg_probability,
 max(timestamp) as latest_prediction, round(avg(capital_prestado),4) as avg_loan_amount,
 round(avg(puntaje_datacredito),4) as avg_credit_score,
 (select string_agg(risk_level||'='||n, ';' order by risk_level) from (select risk_level, count(*) n from last7 group by 1)) as risk_distribution
 from last7""",
    ),
    "risk_counts": (["log"], "select risk_level, count(*) as n from log where risk_level is not null group by 1 order by n desc, 1"),
    "daily_counts": (["last14"], "select strftime(timestamp,'%Y-%m-%d') as day, count(*) as n from last14 group by 1"),
    "amount_histogram": (
        ["last14"],
        """select bucket, round(lo+(hi-lo)/15*(bucket-1),4) as low_edge, count(*) as n from (
 select cast(least(floor((capital_prestado-lo)/((hi-lo)/15))+1,15) as int) as bucket, lo, hi
 from last14, (select min(capital_prestado) lo, max(capital_prestado) hi from last14) where capital_prestado is not null)
 group by bucket, lo, hi""",
    ),
    "probability_histogram": (
        ["scored"],
        "select case when label=1 then 'Pago' else 'No Pago' end as actual_class, "
        "cast(least(floor(score*20)+1,20) as int) as bucket, count(*) as n from scored group by 1, 2",
    ),
    "predictions_by_class": (["scored"], "select label as actual, prediction as predicted, count(*) as n from scored group by 1, 2"),
    "probability_over_time": (["last14"], "select id, timestamp, probability from last14 order by timestamp, id"),
    "yearly_total": (
        ["log"],
        "select count(*) as total_predictions from log where timestamp >= timestamp '2023-01-31' and timestamp < timestamp '2024-01-31'",
    ),
    "fold_metric_description": (
        ["fold10counts"],
        "select metric, count(value) as n, "
        + ", ".join(
            f"round({e}, 6) as {a}"
            for a, e in (
                ("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"),
                ("q25", "quantile_cont(value, 0.25)"), ("q50", "quantile_cont(value, 0.5)"),
                ("q75", "quantile_cont(value, 0.75)"), ("max", "max(value)"),
            )
        )
        + " from (with rated as (select * from "
        + _rates("fold10counts", "fold")
        + ") "
        + _long("rated", [(m, m) for m in ("accuracy", "precision_1", "recall_1", "f1_1")])
        + ") group by metric",
    ),
    "segment_performance": (
        ["scored"],
        "select segment, n as cases, round(accuracy,6) as accuracy, "
        f"round({_weighted('precision')},6) as precision, round({_weighted('recall')},6) as recall from "
        + _rates(
            "(select tipo_laboral as segment, count_if(label=0 and prediction=0) n00, count_if(label=0 and prediction=1) n01, "
            "count_if(label=1 and prediction=0) n10, count_if(label=1 and prediction=1) n11 from scored group by 1)",
            "segment",
        ),
    ),
    "executive_summary": (
        ["counts"],
        "select n00+n01+n10+n11 as total_cases, n00+n11 as correct_predictions, "
        "round(100.0*(n00+n11)/(n00+n01+n10+n11),6) as accuracy_pct, n11 as true_positives, n01 as false_positives, "
        "n10 as false_negatives from counts",
    ),
    "error_rate": (["scored"], "select round(avg(case when label<>prediction then 1.0 else 0.0 end),6) as error_rate from scored"),
    "drift_features": (
        ["drifted"],
        "select feature, rn as recent_n, hn as older_n, round(rm,6) as recent_mean, round(hm,6) as older_mean, "
        "round(change_pct,6) as change_pct, round(t_stat,6) as t_stat, drift_detected from drifted",
    ),
    "drift_p_values": (
        ["drifted"],
        """select feature, round(t_stat,6) as t_stat, round(least(1, 2*exp(lgamma((v+1)/2)-lgamma(v/2))/sqrt(pi())*area),6) as p_value
 from (select feature, t_stat, v, step*list_sum([power(cos(low+(i-0.5)*step), v-1) for i in range(1, 40001)]) as area
  from (select *, (least(pi()/2, low+40/sqrt(v))-low)/40000 as step
   from (select feature, t_stat, rn+hn-2.0::double as v, atan(abs(t_stat)/sqrt(rn+hn-2)) as low from drifted)))""",
    ),
    "drift_totals": (["drifted"], "select count(*) as features_analysed, count_if(drift_detected) as features_drifted from drifted"),
    "drift_status": (
        ["last14"],
        """select case when few_new or few_old then 'insufficient_data' else 'ok' end as status,
 case when few_new then 'more predictions are needed' when few_old then 'more history is needed' end as message,
 recent_rows, older_rows from (select *, recent_rows<5 or recent_rows+older_rows<10 as few_new, older_rows<5 as few_old from (
 select count_if(timestamp>=timestamp '2024-01-28') as recent_rows, count_if(timestamp<timestamp '2024-01-28') as older_rows from last14))""",
    ),
    "confusion_matrix": (
        ["counts"],
        " union all ".join(
            f"select cast({a} as int) as actual, cast({b} as int) as predicted, n{a}{b} as n from counts" for a in (0, 1) for b in (0, 1)
        ),
    ),
    "overall_metrics": (
        ["counts"],
        f"select n as cases, round(accuracy,6) as accuracy, round({_weighted('precision')},6) as weighted_precision, "
        f"round({_weighted('recall')},6) as weighted_recall, round({_weighted('f1')},6) as weighted_f1 from {_rates('counts')}",
    ),
    "class_metrics": (["counts"], f"select {_rounded(DETAIL)} from {_rates('counts')}"),
    "classification_report": (["counts"], _report("counts")),
    "roc_curve": (
        ["steps"],
        "select threshold, round(fp/n,6) as fpr, round(tp/p,6) as tpr from steps union all select null, 0, 0",
    ),
    "roc_auc": (["steps"], "select round(sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)),6) as roc_auc from steps"),
    "precision_recall_curve": (
        ["steps"],
        "select threshold, round(tp/(tp+fp),6) as precision, round(tp/p,6) as recall, round(p/(p+n),6) as baseline from steps "
        "union all select null, 1, 0, round(sum(pos)/(sum(pos)+sum(neg)),6) from steps",
    ),
    "average_precision": (["steps"], "select round(sum(pos*tp/(tp+fp))/sum(pos),6) as average_precision from steps"),
    "base_features": (["base"], "select * replace (round(puntaje_datacredito,6) as puntaje_datacredito) from base"),
    "reloaded_base_features": (["base"], "select * replace (round(puntaje_datacredito,6) as puntaje_datacredito) from base"),
    "standardised_columns": (
        ["base"],
        "select loan_id, " + ", ".join(f"round({_standardised(c)},6) as num__{c}" for c in NUMBERS) + " from base",
    ),
    "design_matrix_totals": (
        ["base"],
        " union all ".join(
            [f"select 'cat__{c}_'||{c} as feature, cast(count(*) as double) as total from base group by {c}" for c in CATEGORIES]
            + [f"select 'num__{c}' as feature, round(sum(z),3)+0.0::double as total from (select {_standardised(c)} as z from base)" for c in NUMBERS]
        ),
    ),
    "design_matrix": (
        ["base"],
        "select loan_id, cast(unnest(range(0, len(v))) as int) as place, unnest(v) as value from (select loan_id, list_concat(["
        + ", ".join(f"round({_standardised(c)},6)+0.0::double" for c in NUMBERS) + "], "
        + ", ".join(
            f"list_transform((select list(x order by x) from (select distinct {c} as x from base)), lambda x: case when x={c} then 1.0::double else 0.0::double end)"
            for c in CATEGORIES
        ) + ") as v from base)",
    ),
    "loaded_model_description": (
        ["base", "split"],
        "select 'LogisticRegressionModel' as model_name, 'pyspark.ml.classification' as model_type, "
        f"cast({len(NUMBERS)}+" + "+".join(f"count(distinct {c})" for c in CATEGORIES) + " as int) as features_count, "
        "'DropColumns,MissingValueFillerModel,KeepBelow,LoanDateFeatures,AsCategory,DropColumns,ExcludeCategories,"
        "PopulationScalerModel,FillMissingCategory,StringIndexerModel,OneHotEncoderModel,VectorAssembler' as stages "
        "from base join split using (loan_id) where not is_test",
    ),
    "stratified_split": (["split"], "select * from split"),
    "stratified_folds": (["folds"], "select loan_id, label as Pago_atiempo, fold from folds"),
    "shuffle_splits": (
        ["repeats"],
        "select cast(repeat as int) as repeat, is_test, count(*) as n, cast(sum(loan_id) as bigint) as key_sum, "
        "cast(sum(label) as bigint) as positives from repeats group by 1, 2",
    ),
    "fold_metrics": (["foldcounts", "foldareas"], f"select fold, {_rounded([*DETAIL, 'roc_auc', 'pr_auc'])} from {_FOLD_DETAILED}"),
    "fold_metric_spread": (
        ["foldcounts", "foldareas"],
        "select "
        + ", ".join(
            f"round({fn}({m}),6) as {m}_{s}" for s, fn in (("mean", "avg"), ("std", "stddev_samp")) for m in [*DETAIL, "roc_auc", "pr_auc"]
        )
        + f" from {_FOLD_DETAILED}",
    ),
    "cross_validation_report": (
        ["foldcounts", "foldareas"],
        "select metric, round(avg(value),6) as mean, round(stddev_pop(value),6) as std, round(min(value),6) as min, round(max(value),6) as max "
        f"from (with rated as (select * from {_FOLD_DETAILED}) " + _long("rated", list(_METRIC_NAMES.items())) + ") group by metric",
    ),
    "model_results": (
        ["partcounts", "partareas"],
        f"select *, {_STABILITY} as stability from (select model, {_RESULT_COLUMNS} from {_DETAILED_PARTS} group by model)",
    ),
    "model_leaderboard": (
        ["partcounts", "partareas"],
        f"""select model, cast(row_number() over (order by credit_score desc nulls last, model) as int) as position,
 round(credit_score,5) as credit_score from (select model, case when raw is null then null else greatest(raw,0) end as credit_score from (
 select model, 0.6*(cv_roc_auc_mean-min(cv_roc_auc_mean) over ())/nullif(max(cv_roc_auc_mean) over ()-min(cv_roc_auc_mean) over (),0)
 +0.3*(cv_recall_0_mean-min(cv_recall_0_mean) over ())/nullif(max(cv_recall_0_mean) over ()-min(cv_recall_0_mean) over (),0)
 -0.1*cv_roc_auc_std-0.1*cv_recall_0_std as raw from (select model, {_RESULT_RAW} from {_DETAILED_PARTS} group by model)))""",
    ),
    "rule_learning_curve": (
        ["repeats", "resized"],
        """select cast(t.repeat as int) as repeat, f.fraction, count(*) as train_rows,
 round(coalesce(count_if(label=1 and prediction=1)/nullif(count_if(label=1),0),0),6) as train_score,
 round(any_value(v.score),6) as validation_score
 from resized t, (select unnest([0.1,0.325,0.55,0.775,1.0])::double as fraction) f,
 (select repeat, coalesce(count_if(label=1 and prediction=1)/nullif(count_if(label=1),0),0) as score from repeats where is_test group by repeat) v
 where v.repeat=t.repeat and t.place<=greatest(1,floor(f.fraction*t.train_n)) group by t.repeat, f.fraction""",
    ),
    "baseline_report": (["ruledcounts"], _report("ruledcounts")),
    "baseline_confusion": (
        ["ruledcounts"],
        " union all ".join(
            f"select cast({a} as int) as actual, cast({b} as int) as predicted, n{a}{b} as n from ruledcounts" for a in (0, 1) for b in (0, 1)
        ),
    ),
    "baseline_learning_curve": (
        ["ruledsplit"],
        """select fraction, round(avg(t),6) as train_score_mean, round(avg(v),6) as validation_score_mean,
 round(stddev_pop(t),6) as train_score_std, round(stddev_pop(v),6) as validation_score_std, round(avg(t)-avg(v),6) as gap
 from (with copies as (select label, prediction, repeat, row_number() over (partition by repeat order by md5(loan_id||':'||repeat||':123')) as place,
  count(*) over (partition by repeat) as n, ceil(cast(0.2 as double)*count(*) over (partition by repeat)) as held
  from ruledsplit, range(1, 51) r(repeat) where not is_test),
 v as (select repeat, coalesce(count_if(label=1 and prediction=1)/nullif(count_if(label=1),0),0) as v from copies where place<=held group by repeat)
 select repeat, fraction, coalesce(count_if(label=1 and prediction=1)/nullif(count_if(label=1),0),0) as t, any_value(v.v) as v
 from copies join v using (repeat), (select unnest([0.1,0.325,0.55,0.775,1.0])::double as fraction) f
 where place>held and place-held<=greatest(1,floor(fraction*(n-held))) group by repeat, fraction) group by fraction""",
    ),
    "baseline_folds": (
        ["ruledfolds"],
        "select cast(fold as int) as fold, round(accuracy,6) as accuracy, round(precision_1,6) as precision, "
        f"round(recall_1,6) as recall, round(f1_1,6) as f1 from {_rates('ruledfolds', 'fold')}",
    ),
    "batch_scoring": (
        ["ruled", "credit"],
        "select s.loan_id, c.puntaje, s.prediction, cast(s.probability as double) as probability, s.risk_level, s.recommendation from ("
        + _bands_of("case when prediction=1 then 0.5 else 0.3 end")
        + ") s join credit c using (loan_id)",
    ),
    "excluded_from_scoring": (["excluded"], "select loan_id, excluded_because from excluded where excluded_because<>''"),
    "labelled_evaluation": (
        ["excluded", "ruled"],
        "select e.loan_id, e.Pago_atiempo, "
        "cast(case when ok then s.prediction else 0 end as int) as prediction, "
        "cast(case when ok then s.probability else 0.5 end as double) as probability, "
        "case when ok then s.risk_level else 'Error' end as risk_level "
        "from (select *, violations='' and excluded_because='' as ok from excluded) e left join ("
        + _bands_of("case when prediction=1 then 0.5 else 0.3 end")
        + ") s using (loan_id)",
    ),
    "first_stored_model": (["ruled"], "select loan_id, 'model_logistic' as name, prediction from ruled"),
    "stored_model_evaluation": (["ruled"], "select loan_id, prediction, cast(null as double) as probability from ruled"),
    "streamed_scoring": (
        ["excluded", "ruled"],
        "select s.prediction, cast(s.probability as double) as probability, s.risk_level, e.capital_prestado, e.plazo_meses, "
        "e.edad_cliente, e.salario_cliente, e.puntaje_datacredito "
        "from excluded e join ("
        + _bands_of("case when prediction=1 then 0.5 else 0.3 end")
        + ") s using (loan_id) where violations='' and excluded_because=''",
    ),
    "streamed_rejections": (
        ["excluded"],
        "select loan_id, concat_ws(',', nullif(violations,''), nullif(excluded_because,'')) as reasons from excluded "
        "where violations<>'' or excluded_because<>''",
    ),
    "train_naive_bayes": (
        ["gausscounts", "gausssteps"],
        f"select 'naive_bayes' as model, {_rounded(DETAIL)}, round(roc_auc,6) as roc_auc, round(pr_auc,6) as pr_auc from {_rates('gausscounts')}, "
        "(select sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)) as roc_auc, sum(pos*tp/(tp+fp))/sum(pos) as pr_auc from gausssteps)",
    ),
    "decision_tree_splits": (
        ["rootsplit", "childsplits"],
        "select node, cast(place as int) as place, round(cut,6) as cut, round(gain,4) as gain "
        "from (select * from rootsplit union all select * from childsplits)",
    ),
    **{
        f"{name}_certificate": (
            ["modelrows"],
            " union all ".join(
                [f"select distinct 'cat__{c}_'||{c} as feature, 0.0::double as gradient from modelrows where not is_test" for c in CATEGORIES]
                + [f"select '{n}' as feature, 0.0::double as gradient" for n in [*[f"num__{c}" for c in NUMBERS], "intercept"]]
            ),
        )
        for name in ("logistic", "linear_svc")
    },
    "streamed_daily_counts": (["log"], "select strftime(timestamp,'%Y-%m-%d') as day, count(*) as n from log group by 1"),
}


def _with(names: list[str]) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as materialized ({PARTS[n][1]})" for n in ordered)


def oracle_queries() -> dict[str, str]:
    return {name: f"{_with(parts)}\n{final}" for name, (parts, final) in SELECTS.items()}
