"""Korean headers and value labels for exported results.

The operators return English snake_case columns and codes. ``localize`` turns
them into the headers and labels of the published tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Headers of the published tables, in column order.
HEADERS: dict[str, dict[str, str]] = {
    "difficulty_factors": {
        "content_id": "콘텐츠 ID",
        "content_name": "콘텐츠명",
        "difficulty": "난이도",
        "content_type": "콘텐츠 유형",
        "recommended_combat_power": "권장 전투력",
        "total_attempt_count": "전체 시도 수",
        "clear_count": "클리어 수",
        "fail_count": "실패 수",
        "give_up_count": "포기 수",
        "disconnect_count": "접속 종료 수",
        "target_clear_rate": "목표 클리어율(%)",
        "clear_rate_pct": "실제 클리어율(%)",
        "clear_rate_gap_pp": "목표 대비 클리어율 차이(%p)",
        "fail_rate_pct": "실제 실패율(%)",
        "difficulty_avg_fail_rate_pct": "동일 난이도 평균 실패율(%)",
        "fail_rate_gap_pp": "동일 난이도 대비 실패율 차이(%p)",
        "target_death_count_avg": "목표 평균 사망 횟수",
        "avg_death_count": "실제 평균 사망 횟수",
        "death_count_gap_pct": "목표 대비 사망 횟수 차이율(%)",
        "target_avg_clear_time_sec": "목표 평균 클리어 시간(초)",
        "avg_clear_time_sec": "실제 평균 클리어 시간(초)",
        "clear_time_gap_pct": "목표 대비 클리어 시간 차이율(%)",
        "fail_rate_flag": "실패율 스택",
        "death_count_flag": "사망 횟수 스택",
        "clear_time_flag": "클리어 시간 스택",
        "difficulty_flag_sum": "난이도 요인 스택 합계",
        "difficulty_verdict": "난이도 요인 판단",
    },
    "eligible_participation": {
        "content_id": "콘텐츠 ID",
        "content_name": "콘텐츠명",
        "content_type": "콘텐츠 유형",
        "difficulty": "난이도",
        "required_level": "요구 레벨",
        "recommended_combat_power": "권장 전투력",
        "eligible_character_count_100": "권장 전투력 이상 캐릭터 수",
        "eligible_character_count_80": "권장 전투력 80% 이상 캐릭터 수",
        "actual_attempt_character_count": "전체 실제 도전 캐릭터 수",
        "actual_attempt_character_count_100": "권장 전투력 이상 실제 도전 캐릭터 수",
        "actual_attempt_character_count_80": "권장 전투력 80% 이상 실제 도전 캐릭터 수",
        "actual_attempt_character_count_under_80": "권장 전투력 80% 미만 실제 도전 캐릭터 수",
        "total_attempt_count": "전체 시도 수",
        "participation_rate_100_pct": "권장 이상 캐릭터 대비 실제 참여율(%)",
        "participation_rate_80_pct": "권장 80% 이상 캐릭터 대비 실제 참여율(%)",
        "under_80_character_share_pct": "권장 80% 미만 도전 캐릭터 비중(%)",
        "difficulty_avg_participation_rate_100_pct": "동일 난이도 평균 권장 이상 참여율(%)",
        "participation_rate_100_gap_pp": "동일 난이도 대비 권장 이상 참여율 차이(%p)",
        "difficulty_avg_participation_rate_80_pct": "동일 난이도 평균 권장 80% 이상 참여율(%)",
        "participation_rate_80_gap_pp": "동일 난이도 대비 권장 80% 이상 참여율 차이(%p)",
        "avg_attempts_per_character": "도전 캐릭터당 평균 시도 수",
        "difficulty_avg_attempts_per_character": "동일 난이도 평균 도전 캐릭터당 시도 수",
        "attempts_per_character_gap": "동일 난이도 대비 캐릭터당 시도 수 차이",
        "difficulty_avg_attempt_count": "동일 난이도 평균 전체 시도 수",
        "attempt_count_gap": "동일 난이도 대비 전체 시도 수 차이",
        "clear_rate_pct": "클리어율(%)",
        "fail_rate_pct": "실패율(%)",
        "give_up_rate_pct": "포기율(%)",
        "disconnect_rate_pct": "접속 종료율(%)",
        "participation_verdict": "참여 규모 판단",
    },
    "power_segments": {
        "content_id": "콘텐츠ID",
        "content_name": "콘텐츠명",
        "difficulty": "난이도",
        "party_size": "파티 인원",
        "power_band": "전투력 구간",
        "recommended_combat_power": "권장 전투력",
        "attempt_count": "전체 시도 수",
        "character_count": "도전 캐릭터 수",
        "clear_count": "클리어 시도 수",
        "clear_rate_pct": "클리어율(%)",
        "target_clear_rate": "목표 클리어율(%)",
        "clear_rate_gap_pp": "목표 대비 차이(%p)",
        "fail_count": "실패 시도 수",
        "fail_rate_pct": "실패율(%)",
        "target_status": "목표 달성 여부",
    },
    "reward_by_result": {
        "result": "결과",
        "attempt_count": "시도 수",
        "character_count": "참여 캐릭터 수",
        "attempt_share_pct": "결과 비중(%)",
        "avg_death_count": "평균 사망 수",
        "avg_duration_sec": "평균 진행 시간(초)",
        "reward_claimed_count": "보상 수령 시도 수",
        "avg_reward_quantity": "시도당 평균 보상 수량",
        "avg_reward_value": "시도당 평균 보상 가치",
        "avg_reward_value_when_paid": "보상 지급 시 평균 보상 가치",
        "avg_reward_value_per_minute": "분당 평균 보상 가치",
    },
    "reward_by_tier": {
        "content_name": "콘텐츠명",
        "content_type": "콘텐츠 유형",
        "difficulty": "난이도",
        "attempt_count": "시도 수",
        "character_count": "참여 캐릭터 수",
        "clear_rate_pct": "클리어율(%)",
        "fail_rate_pct": "실패율(%)",
        "give_up_rate_pct": "포기율(%)",
        "disconnect_rate_pct": "접속 종료율(%)",
        "avg_clear_time_sec": "클리어 성공 시 평균 시간(초)",
        "avg_duration_sec": "전체 시도 평균 진행 시간(초)",
        "avg_reward_value_per_clear": "클리어 시 평균 보상 가치",
        "avg_reward_value": "시도당 평균 보상 가치",
        "clear_reward_value_per_minute": "클리어 기준 분당 보상 가치",
        "reward_value_per_minute": "전체 시도 기준 분당 보상 가치",
    },
    "reward_by_line": {
        "content_name": "콘텐츠명",
        "difficulty": "난이도",
        "recommended_combat_power": "권장 전투력",
        "expected_clear_time_sec": "예상 클리어 시간(초)",
        "attempt_count": "시도 수",
        "character_count": "참여 캐릭터 수",
        "clear_rate_pct": "클리어율(%)",
        "fail_rate_pct": "실패율(%)",
        "give_up_rate_pct": "포기율(%)",
        "avg_clear_time_sec": "클리어 성공 시 평균 시간(초)",
        "avg_reward_value_per_clear": "클리어 시 평균 보상 가치",
        "clear_reward_value_per_minute": "클리어 기준 분당 보상 가치",
        "avg_reward_value": "전체 시도 기준 평균 보상 가치",
    },
    "release_maturity": {
        "content_name": "콘텐츠명",
        "content_type": "콘텐츠 유형",
        "difficulty": "난이도",
        "release_date": "출시일",
        "first_attempt_date": "첫 시도일",
        "reference_date": "분석 기준일",
        "days_since_release": "출시 후 경과 일수",
        "attempt_count": "총 시도 수",
        "character_count": "참여 캐릭터 수",
        "target_clear_rate": "목표 클리어율(%)",
        "clear_rate_pct": "실제 클리어율(%)",
        "clear_rate_gap_pp": "목표 대비 클리어율 차이(%p)",
        "release_stage": "운영 판단 기준",
    },
    "band_performance": {
        "power_band": "전투력 구간",
        "attempt_count": "시도 수",
        "character_count": "참여 캐릭터 수",
        "avg_combat_power": "평균 캐릭터 전투력",
        "avg_power_ratio_pct": "권장 전투력 대비 평균 비율(%)",
        "target_clear_rate": "목표 클리어율(%)",
        "clear_rate_pct": "클리어율(%)",
        "fail_rate_pct": "실패율(%)",
        "give_up_rate_pct": "포기율(%)",
        "disconnect_rate_pct": "접속 종료율(%)",
        "clear_rate_gap_pp": "목표 대비 클리어율 차이(%p)",
        "avg_death_count": "평균 사망 수",
        "target_death_count_avg": "목표 평균 사망 수",
        "death_count_gap": "목표 대비 사망 수 차이",
        "avg_clear_time_sec": "클리어 성공 시 평균 클리어 시간(초)",
        "target_avg_clear_time_sec": "목표 평균 클리어 시간(초)",
        "clear_time_gap_sec": "목표 대비 클리어 시간 차이(초)",
    },
    "pattern_impact": {
        "phase_no": "페이즈",
        "pattern_code": "패턴 코드",
        "pattern_name": "패턴명",
        "exposed_attempt_count": "패턴 노출 시도 수",
        "hit_attempt_count": "피격 시도 수",
        "hit_rate_pct": "피격률(%)",
        "fatal_attempt_count": "사망 유발 시도 수",
        "fatal_share_pct": "사망 유발 비중(%)",
        "avg_damage_when_hit": "피격 시 평균 피해량",
        "fail_rate_pct": "패턴 노출 후 실패율(%)",
        "fail_rate_hit_pct": "피격 시 실패율(%)",
        "fail_rate_avoided_pct": "회피 시 실패율(%)",
        "fail_rate_difference_pp": "피격-회피 실패율 차이(%p)",
    },
    "pattern_by_result": {
        "result": "시도 결과",
        "pattern_attempt_count": "{code} 발생 시도 수",
        "pattern_log_count": "{code} 로그 수",
        "hit_log_count": "피격 로그 수",
        "hit_rate_pct": "피격률(%)",
        "fatal_log_count": "사망 유발 로그 수",
        "fatal_share_pct": "사망 유발 비중(%)",
        "avg_damage": "평균 피해량",
    },
    "pattern_incidence_by_band": {
        "power_band": "전투력 구간",
        "attempt_count": "전체 시도 수",
        "fail_count": "실패 시도 수",
        "pattern_attempt_count": "{code} 발생 시도 수",
        "pattern_rate_pct": "전체 시도 대비 {code} 발생률(%)",
        "pattern_per_fail_pct": "실패 시도 대비 {code} 비중(%)",
        "clear_rate_pct": "클리어율(%)",
        "fail_rate_pct": "실패율(%)",
    },
}

# Band names of the banded tables.
_BANDS = {
    "01_under_80": "01_80% 미만",
    "02_80_to_100": "02_80% 이상~100% 미만",
    "03_100_to_110": "03_100% 이상~110% 미만",
    "04_110_to_120": "04_110% 이상~120% 미만",
    "05_120_and_over": "05_120% 이상",
}

# Labels of the classification columns.
VALUES: dict[str, dict[str, dict[str, str]]] = {
    "usage_overview": {
        "participation_status": {
            "UNUSED": "미이용 콘텐츠",
            "BELOW_PEERS": "동급 대비 참여 낮음",
            "ABOVE_PEERS": "동급 대비 참여 높음",
            "NEAR_PEERS": "동급 평균권",
        },
        "target_participation_status": {
            "BELOW_TARGET": "목표 대비 참여 낮음",
            "ABOVE_TARGET": "목표 대비 참여 높음",
            "NEAR_TARGET": "목표 부근",
        },
        "usage_failure_segment": {
            "HIGH_USE_HIGH_FAILURE": "참여 높음 + 실패 부담 높음",
            "LOW_USE_LOW_FAILURE": "참여 낮음 + 실패 부담 낮음",
            "LOW_USE_HIGH_FAILURE": "참여 낮음 + 실패 부담 높음",
            "HIGH_USE_LOW_FAILURE": "참여 높음 + 실패 부담 낮음",
            "OTHER": "기타",
        },
    },
    "difficulty_factors": {
        "difficulty_verdict": {
            "DIFFICULTY_LIKELY": "난이도 문제 가능성 높음",
            "DIFFICULTY_POSSIBLE": "난이도 문제 가능성 있음",
            "DIFFICULTY_UNLIKELY": "난이도 문제 가능성 낮음",
        },
    },
    "eligible_participation": {
        "participation_verdict": {
            "LOW_ENTRY_LOW_REPEAT": "도전 가능 캐릭터 대비 참여 낮고 반복 도전도 낮음",
            "LOW_ENTRY_BUT_REPEATING": "도전 가능 캐릭터 대비 참여는 낮지만 참여 캐릭터는 반복 도전",
            "ENTERED_BUT_FAILING": "도전 가능 캐릭터 대비 참여는 있으나 실패 부담 높음",
            "MANY_UNDER_POWERED": "권장 전투력 미달 캐릭터 진입 비중 높음",
            "HEALTHY": "도전 가능 캐릭터 대비 참여 규모 양호",
            "CHECK_FURTHER": "추가 확인 필요",
        },
    },
    "power_segments": {
        "power_band": {
            "01_under_80": "권장 전투력 80% 미만",
            "02_80_to_100": "권장 전투력 80~100%",
            "03_100_to_110": "권장 전투력 100~110%",
            "04_110_to_120": "권장 전투력 110~120%",
            "05_120_and_over": "권장 전투력 120% 이상",
        },
        "target_status": {"BELOW_TARGET": "목표 미달"},
    },
    "release_maturity": {
        "release_stage": {
            "OBSERVE": "출시 초기: 개선 확정보다 관찰 우선",
            "SETTLING": "초기 적응 구간: 관찰과 부분 개선 검토",
            "SETTLED": "충분한 기간 경과: 개선 후보로 판단 가능",
        },
    },
    "band_performance": {"power_band": _BANDS},
    "pattern_incidence_by_band": {"power_band": _BANDS},
}


def localize(df: DataFrame, operator: str, code: str = "") -> DataFrame:
    """Published headers and labels for the result of ``operator``.

    ``code`` fills in the pattern code in the headers that name it. Columns and
    operators without a published label keep their names.
    """
    for column, labels in VALUES.get(operator, {}).items():
        if column in df.columns:
            df = df.replace(labels, subset=[column])
    headers = {name: header.format(code=code) for name, header in HEADERS.get(operator, {}).items()}
    return df.withColumnsRenamed(headers)
