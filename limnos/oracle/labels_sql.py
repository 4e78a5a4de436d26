"""Oracle SQL: labelling and risk."""

from .base import WITH_BASE

SQL = {
    "flagship": WITH_BASE + """
SELECT core_parameter_count, available_compliance_label, risk_category,
       count(*) AS samples, round(avg(risk_score), 6) AS avg_risk_score,
       round(max(risk_score), 6) AS max_risk_score
FROM labelled_risk GROUP BY ALL""",
    "lbl_compliance": WITH_BASE + """
SELECT station_id, sampling_date, available_compliance_label, strict_compliance_label,
       core_parameter_count, available_compliance_parameters, missing_required_parameters,
       label_confidence, violation_reasons, violation_count
FROM labelled_risk""",
    "rsk_score": WITH_BASE + """
SELECT station_id, sampling_date, risk_score, risk_category, risk_confidence FROM labelled_risk""",
}

SQL["rsk_category"] = WITH_BASE + """
SELECT station_id, sampling_date, risk_score,
  CASE WHEN risk_score IS NULL THEN 'Unknown' WHEN risk_score <= 25 THEN 'Low Risk' WHEN risk_score <= 50 THEN 'Moderate Risk'
    WHEN risk_score <= 75 THEN 'High Risk' ELSE 'Severe Risk' END AS risk_band
FROM labelled_risk"""
