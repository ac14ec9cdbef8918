"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T

_s, _d, _l, _i, _b, _t = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SAMPLES = _struct(trace_id=_s, net=_s, sta=_s, loc=_s, cha=_s, i=_l, ts=_t, v=_d)

INVENTORY = _struct(
    arquivo=_s, caminho=_s, rede=_s, estacao=_s, canal=_s, taxa_hz=_d, n_amostras=_l, duracao_s=_d, starttime=_t,
    var_global=_d, var_min=_d, var_max=_d, razao_var=_d, t_evento_est=_d, xml_disponivel=_b, status=_s, classificacao=_s,
)

TRIGGER_RESULTS = _struct(arquivo=_s, razao_var=_d, t_real=_d, detectado=_b, n_alarmes=_i, score=_d)

CATALOG = _struct(evid=_s, ano=_i, doy=_i, datetime=_t, mag=_d, lat=_d, lon=_d, depth=_d)

RESULT_RECORD = _struct(
    metodo=_s, versao=_s, parametros=T.MapType(_s, _d), hiperparametros=T.MapType(_s, _d), threshold=_d, precisao=_d,
    recall=_d, f1=_d, auc=_d, tamanho_kb=_d, inferencia_ms=_d, inferencia_std=_d, n_params=_l, best_val_loss=_d,
)
