"""Keyword lists of detectors."""

from __future__ import annotations

#: Search domains and their keywords.
DOMAINS = {
    "color": ["color", "palette", "hex", "#", "rgb"],
    "chart": ["chart", "graph", "visualization", "trend", "bar", "pie", "scatter", "heatmap", "funnel"],
    "landing": ["landing", "page", "cta", "conversion", "hero", "testimonial", "pricing", "section"],
    "product": ["saas", "ecommerce", "e-commerce", "fintech", "healthcare", "gaming", "portfolio", "crypto", "dashboard"],
    "style": ["style", "design", "ui", "minimalism", "glassmorphism", "neumorphism", "brutalism", "dark mode", "flat", "aurora", "prompt", "css", "implementation", "variable", "checklist", "tailwind"],
    "ux": ["ux", "usability", "accessibility", "wcag", "touch", "scroll", "animation", "keyboard", "navigation", "mobile"],
    "typography": ["font", "typography", "heading", "serif", "sans"],
    "icons": ["icon", "icons", "lucide", "heroicons", "symbol", "glyph", "pictogram", "svg icon"],
    "react": ["react", "next.js", "nextjs", "suspense", "memo", "usecallback", "useeffect", "rerender", "bundle", "waterfall", "barrel", "dynamic import", "rsc", "server component"],
    "web": ["aria", "focus", "outline", "semantic", "virtualize", "autocomplete", "form", "input type", "preconnect"],
}

#: Page types, the first that fits counts.
PAGE_TYPES = [
    (["dashboard", "admin", "analytics", "data", "metrics", "stats", "monitor", "overview"], "Dashboard / Data View"),
    (["checkout", "payment", "cart", "purchase", "order", "billing"], "Checkout / Payment"),
    (["settings", "profile", "account", "preferences", "config"], "Settings / Profile"),
    (["landing", "marketing", "homepage", "hero", "home", "promo"], "Landing / Marketing"),
    (["login", "signin", "signup", "register", "auth", "password"], "Authentication"),
    (["pricing", "plans", "subscription", "tiers", "packages"], "Pricing / Plans"),
    (["blog", "article", "post", "news", "content", "story"], "Blog / Article"),
    (["product", "item", "detail", "pdp", "shop", "store"], "Product Detail"),
    (["search", "results", "browse", "filter", "catalog", "list"], "Search Results"),
    (["empty", "404", "error", "not found", "zero"], "Empty State"),
]

#: Page types by what the best style result is good for.
PAGE_TYPES_BY_STYLE = [
    (["dashboard", "data"], "Dashboard / Data View"),
    (["landing", "marketing"], "Landing / Marketing"),
]

#: Layouts by words among the style's keywords (width, layout, density), the layout of other styles, and what is said without any result.
LAYOUTS = [
    (["data", "dense", "dashboard", "grid"], "1400px or full-width", "12-column grid for data flexibility", "High — optimize for information display"),
    (["minimal", "simple", "clean", "single"], "800px (narrow, focused)", "Single column, centered", "Low — focus on clarity"),
]
LAYOUT_ELSE = ("1200px (standard)", "Full-width sections, centered content", None)
GENERIC_ADVICE = ["Refer to MASTER.md for all design rules", "Add specific overrides as needed for this page"]

#: Theme words of design intents.
INTENTS = {
    "cold": ["tech", "数据", "data", "AI", "科技", "digital", "analytics", "分析"],
    "nature": ["green", "绿色", "环保", "eco", "sustainability", "生态", "forest"],
    "neutral": ["report", "报告", "finance", "财务", "annual", "年度", "corporate"],
    "energy": ["marketing", "运营", "social", "品牌", "campaign", "活动", "launch"],
    "authority": ["luxury", "奢华", "fashion", "时尚", "premium", "高端", "gala", "formal", "正式", "professional", "专业", "government", "政府", "bidding", "投标", "政府报告", "政府文书", "公文", "thesis", "毕业论文", "dissertation", "开题", "开题报告", "proposal", "学位"],
    "calm": ["health", "健康", "meditation", "wellness", "calm", "医疗", "minimalist", "极简", "simple", "简约"],
    "tension": ["urgent", "warning", "紧急", "alert", "crisis"],
    "warmth": ["food", "美食", "lifestyle", "生活", "home", "家居"],
}
