"""The rule gate for product claims."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and quantities that make a claim, and what rules a text out.
CLAIM_WORDS = (
    "淡化 改善 修护 修复 保湿 补水 紧致 抗皱 抗老 抗氧 抗醣 抗糖 提亮 美白 焕亮 舒缓 控油 祛痘 减少 降低 提升 增强 保护 促进 "
    "细纹 皱纹 毛孔 弹性 屏障 损伤 胶原 饱满 光泽 透亮 柔嫩 平滑 净澈 匀净 添加 蕴含 富含 配方 成分 玻尿酸 透明质酸 烟酰胺 "
    "甘草酸 维生素 视黄醇 胜肽 神经酰胺 水杨酸 果酸 精华 测试 实验 实证 验证 认证 临床 真人 消费者 使用前 使用后 "
    "区域 荧光 基底膜 真表皮 肤质 肌肤 皮肤 清爽 滋润 不黏腻"
).split()
CLAIM_QUANTITY = r"\d+(?:[.,]\d+)?\s*[%％倍小时天周月]"
EXCLUDED = (r"^[¥￥]\s*\d", r"^\d{8,}$", r"\b\d+(?:\.\d+)?\s*(?:ml|mL|ML|g|kg|克|千克|毫升)\b")
EXCLUDED_WORDS = "条形码 净含量 规格 生产许可证 执行标准 保质期".split()

DEFAULT_BRANDS = ("SkinCeuticals", "修丽可")


def matches(c: Column, patterns: Iterable[str]) -> Column:
    return c.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def gate(text: Column, include: Iterable[str], exclude: Iterable[str], brands: Iterable[str] = ()) -> Column:
    """Whether a text without its white space is not empty, not excluded, no brand, and matches `include`."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    keep = (bare != "") & matches(bare, include)
    exclude, brands = list(exclude), [b.casefold() for b in brands]
    if exclude:
        keep = keep & ~matches(bare, exclude)
    if brands:
        keep = keep & ~F.lower(bare).isin(brands)
    return keep


def is_claim(text: Column, brands: Iterable[str] = ()) -> Column:
    return gate(text, [*CLAIM_WORDS, CLAIM_QUANTITY], [*EXCLUDED, *EXCLUDED_WORDS], brands)


def claim_lines(lines: Column, brands: Iterable[str] = (), all_text: bool = False) -> Column:
    """Of an array of lines those that are claims, or all; `brands` are ruled out besides the default ones."""
    return lines if all_text else F.filter(lines, lambda x: is_claim(x, [*DEFAULT_BRANDS, *brands]))
