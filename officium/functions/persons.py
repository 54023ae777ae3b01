"""Whether a text can be a person's name, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no names; beginnings, endings and parts that names don't have.
NO_NAMES = (
    "人事 决定 任命 免去 经研究 各单位 现将 现予 公告 通知 有关 省税务局 市税务局 区税务局 县税务局 税务局 国家税务 工作人员 专题专栏 主要职能 内设机构 发票查询 总局概况 所得税司 "
    "教育中心 新浪微博 新闻发布 查看更多 派出机构 直属单位 直属机构 访问统计 重要活动 社保 信息公开 主要职责 行政许可 行政处罚 市局链接 网站首页 工作动态 分管工作 联系单位 网站纠错 "
    "市局频道 市州频道 区县频道 房产税 印花税 局长信箱 负责党委 政策法规 政策解读 新闻宣传 权责清单 行政检查 政府采购 二维码 我要申请 申请须知 隐私声明 中标公告 招标公告 文件解读 "
    "预算决算 最新文件 采购意向 执法公示 网站建议 总经济师 总会计师 总审计师"
).split()
NO_BEGINNINGS = "关于 任命 任免 决定 免去 经研究 现将 命 免 去 将 其 等".split()
NO_ENDINGS = "局 处 科 所 部 组 司 职务 通知 决定 中心 区 链接 市 州 税 频道 公告 须知 声明 文件 解读 清单 地区".split()
NO_PARTS = (
    "财产 行为 税收 税务 管理 稽查 办公 人事 党委 纪检 退休 老干 分局 研究所 职能 概况 查询 微博 发布 统计 活动 机构 专栏 更多 频道 "
    "法规 解读 宣传 清单 公开 指南 须知 声明 预算 决算 采购 招标 中标 二维码 权责 隐私 检查 意向 经济师 会计师 审计师 申请 公示 建议 公告 "
    "不再 同志 职务 挂职 任用 试用 正式 拟任 任命 免去 担任 兼任 聘任 局长 科长 处长 所长 总局 层次 人选 民主 推荐"
).split()


def plausible_name(name: Column) -> Column:
    """Two to four Chinese letters that are no known word, organization, title or phrase of a notice; false for null."""
    text = F.trim(name)
    never = f"^(?:{'|'.join(NO_BEGINNINGS)})|(?:{'|'.join(NO_ENDINGS)})$|{'|'.join(NO_PARTS)}|^[一-龥]税[一-龥]{{1,2}}$"
    return F.coalesce(text.rlike("^[一-龥·]{2,4}$") & ~text.isin(*NO_NAMES) & ~text.rlike(never), F.lit(False))


def clean_name(raw: Column) -> Column:
    """A matched name without what the pattern took along."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), "(?:同志)+$", ""), "^免去?", "")
    return F.when(text.startswith("去") & (F.length(text) >= 3), F.substring(text, 2, 100)).otherwise(text)
