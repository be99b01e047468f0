"""Template leftovers, filler and error-page text instead of content.

Unfilled placeholders are found by one grammar per kind of delimiter, discounted inside code spans and in texts about
templates unless they make up most of the text. The other kinds are phrases that must fill a whole segment of the text
(the parts between ``|``, ``-``, ``:`` ...), so that titles which merely mention them stay. Everything runs as regular
expressions in the JVM on the canonical form of the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import lookalikes
from loomstone.session import once

# Names of fields that shops and page templates fill in.
FIELD_WORDS = "标题|品牌|规格|商品名称|商品名|商品标题|店铺名称|店铺|名称|价格|原价|型号|颜色|尺码|数量|库存|图片|链接|分类|描述|用户名|姓名|日期|时间"
_ID = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*"
_NAME = rf"(?:{_ID}|{FIELD_WORDS})"
_ANY = r"[\p{L}_][\p{L}\p{N}_.]*"
_BODY = rf"\s*{_ANY}(?:\s*\|\s*[\w ]+)?\s*"
#: One grammar per delimiter.
PLACEHOLDERS = (
    rf"\{{\{{\{{?{_BODY}(?:\}}\}}\}}?|$|\s*[|·_-])",
    rf"\{{\{{\{{?{_BODY}$",
    rf"\$!?\{{{_BODY}\}}?",
    rf"#\{{{_BODY}\}}",
    rf"<%[=-]?{_BODY}(?:%>|$)",
    rf"\{{%-?{_BODY}-?(?:%\}}|$)",
    rf"%%{_ANY}%%",
    rf"%\({_ANY}\)[sdf]",
    rf"__{_ANY}__",
    rf"@@{_ANY}@@",
    rf"\[\[{_BODY}\]\]",
    r"\[[\p{L}\p{N}_.]*(?:未填写|待填写|请填写|TBD|TODO)\]",
    rf":{_ANY}:placeholder",
    rf"<{_NAME}>|&lt;{_NAME}&gt;",
    rf"\{{{_NAME}\}}",
    r"(?:^|[\s|_-])%[sd](?=$|[\s|_-])",
)
PLACEHOLDER = "(?i)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS)
#: A sign that every placeholder holds; a cheap look before the grammars are tried.
PLACEHOLDER_HINT = r"(?i)[{<%@\[]|__|:placeholder|&lt;"
CODE_SPAN = r"`[^`]*`|<code>.*?</code>"
CODE_TALK = r"(?i)模板|语法|教程|template|syntax|jinja|django|handlebars|mustache|cheat ?sheet|escap(?:e|ing)"

_PUNCT = r"[\s.!?。！？…]*"
_COUNTER = r"(?:\s*[-#]?\s*\d{1,4}){0,2}"
_LOREM = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua"

# Sample and filler texts, whole.
FILLER = (
    rf"(?:(?:{_LOREM})[ ,]+){{2,}}(?:{_LOREM})",
    r"lorem ipsum",
    r"(?:test[ -]?){2,}|(?:asdf ?){1,}|x{4,}|(?:foo|bar|baz)(?: (?:foo|bar|baz))+",
    r"(?:your |product |page )?title goes here|your (?:title|text|heading|product name) here|insert (?:heading|title|text)(?: here)?",
    r"(?:heading|title|text|image) placeholder|placeholder(?: (?:text|title))?|dummy (?:text|title)(?: for layout)?|sample (?:product )?(?:title|text|page)",
    r"untitled(?: (?:page|document|product))?|new page(?: \(draft\))?|todo:? (?:write|add|insert) (?:title|text)",
    r"beispiel(?:titel|text)|blindtext(?: für die vorschau)?|(?:überschrift|titel|text) hier einfügen|platzhalter(?:text)?",
    r"texte de remplissage|insérez le (?:titre|texte) ici|titre à compléter|titre d'exemple",
    r"texto de relleno|escriba aquí el (?:título|texto)|título de ejemplo|título pendiente",
    r"测试(?:标题|商品|页面|数据)?(?:请勿拍(?:下)?)?|(?:标题){2,}|(?:此处|这里|请在此)(?:填写|输入)(?:商品)?(?:标题|名称)|默认标题 ?(?:请修改)?|占位(?:文字|文本|标题) ?(?:待替换)?",
    r"(?:这里|此处)是一段(?:示例|测试|占位)(?:文字|文本)|商品(?:名称|标题)示例|示例(?:商品|标题|文字)|新建(?:商品|页面)|请(?:输入|填写)商品(?:标题|名称)(?: ?\(最多\d+字\))?",
)
#: Values a program prints by mistake, whole.
MISTAKE = (r"(?:\(?(?:null|undefined|nan|none|nil|nul)\)?[\s,]*)+|\[?object[\s_]?(?:object|html\w*|promise|window)\]?|<(?:null|none|undefined|unknown)>|function ?\(\) ?\{ ?\[native code\] ?\}|#(?:n/a|ref!|value!|name\?)",)

_EN_WHAT = r"(?:the|this|our|your|that)?\s*(?:requested |upstream |web |remote )?(?:page|store|shop|link|product|item|listing|server|service|request|resource|article|session|site|website|content|offer)s?(?: you (?:followed|requested|are looking for))?"
_DE_WHAT = r"(?:die|diese|dieser|dieses|der|das|unser[ea]?|ihr[ea]?)\s*(?:angeforderte |gewünschte |verlinkte |aufgerufene )?(?:\p{L}*(?:seite|website|datei|artikel|produkt|shop|laden|server|dienst|link|verbindung|anfrage|sitzung|inhalt|ressource|angebot|zugriff|browser|adresse))"
_FR_WHAT = r"(?:la|le|l'|cette|ce|cet|notre|votre)\s*(?:page|site|boutique|serveur|lien|produit|article|fichier|service|session|requête|demande|contenu|annonce|ressource|offre|adresse|accès|connexion|système|magasin)(?: (?:demandée?|consultée?|distante?|suivi|que vous cherchez))?"
_ES_WHAT = r"(?:la|el|este|esta|nuestro|nuestra|su)\s*(?:página|sitio|enlace|producto|artículo|servidor|servicio|tienda|solicitud|sesión|archivo|contenido|recurso|oferta|web|acceso|conexión|sistema|anuncio|petición)(?: (?:solicitad[oa]|que busca|remoto))?"
#: What a failed page tells of itself.
_EN_FAILS = r"(?:not\b|n't\b|no longer|unavailable|error|problem|wrong|removed|deleted|gone|fail|expired|blocked|offline|timed? ?out|too long|maintenance|down\b)"
_DE_FAILS = r"(?:mehr )?(?:erreichbar|verfügbar|gefunden|vorhanden|aktiv|online|zugänglich|gültig|möglich|erlaubt|geladen|freigegeben|auffindbar)"
_FR_FAILS = r"(?:disponibles?|accessibles?|en ligne|activée?s?|valides?|autorisée?s?|trouvée?s?|existante?s?)"
_ADVICE = r"(?:[.,;:!]?\s+.*)?"
# Messages of failed, waiting, guarded and verification pages, whole.
ERROR = (
    rf"{_EN_WHAT}\s+(?:was not found|(?:could|can) ?not be (?:found|reached|loaded|displayed)|has been (?:removed|deleted|taken down|blocked|suspended)|no longer exists|(?:is|are) (?:currently |temporarily )?(?:unavailable|not available|no longer available)|ran into an? (?:unexpected )?(?:problem|error)|took too long to respond|(?:was|is) blocked|does(?: not|n't) exist|(?:has )?(?:expired|timed out)|is not responding|failed to load|is (?:down|offline|under maintenance)){_ADVICE}",
    rf"(?:sorry|oops|we(?:'re| are) sorry)[,.!]? {_EN_WHAT} .*{_EN_FAILS}.*",
    r"(?:page |file |document |item )?not found|access denied|forbidden|unauthori[sz]ed|bad (?:gateway|request)|gateway time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|(?:request|connection|session) timed? ?out|something went wrong.*|an? (?:unexpected |unknown )?error (?:has )?occurr?ed.*",
    r"loading[,.]* ?(?:please wait)?|please wait|just a moment|checking your browser.*|verify(?:ing)? (?:that )?you are (?:a )?human.*|(?:we are|we're|site|currently) (?:down|closed|offline) for (?:scheduled )?maintenance.*|(?:under|scheduled) maintenance|(?:please )?(?:log|sign) in(?: (?:again|to continue|first)).*|complete the (?:captcha|security check).*|are you a robot|you have been blocked.*|you do not have permission.*",
    rf"{_DE_WHAT}\s+(?:ist (?:derzeit |zurzeit |momentan |vorübergehend |leider )*nicht (?:mehr )?(?:erreichbar|verfügbar|gefunden)|existiert nicht(?: mehr)?|wurde (?:nicht gefunden|entfernt|gelöscht|gesperrt|blockiert)|antwortet nicht|konnte nicht .*|kann nicht .*|ist abgelaufen|ist (?:\p{{L}}+ )?nicht {_DE_FAILS}){_ADVICE}",
    r"(?:seite|datei|artikel) nicht gefunden|zugriff (?:verweigert|gesperrt)|interner serverfehler|es ist ein (?:unerwarteter )?fehler aufgetreten.*|zu viele anfragen|zeitüberschreitung.*|bitte warten.*|wird geladen.*|ihre sitzung ist abgelaufen.*|dienst (?:vorübergehend )?nicht (?:verfügbar|erreichbar)|bitte (?:melden sie sich|bestätigen sie).*|wartungsarbeiten",
    rf"{_FR_WHAT}\s+(?:est (?:introuvable|(?:temporairement |momentanément )?indisponible|inaccessible|bloquée?|expirée?)|n'est (?:plus|pas) {_FR_FAILS}|n'existe (?:plus|pas)|a (?:été .*|expiré|rencontré .*)|ne répond (?:pas|plus)|ne peut .*|est .*introuvable){_ADVICE}",
    r"page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|erreur interne(?: du serveur)?|une erreur (?:inattendue )?est survenue.*|service (?:momentanément|temporairement) indisponible|trop de requêtes|délai d'attente dépassé.*|chargement(?: en cours.*| de la page.*|[.… ]+veuillez.*)?|veuillez (?:patienter|vous (?:re)?connecter|confirmer).*|votre session a expiré.*",
    rf"{_ES_WHAT}\s+(?:no (?:existe|responde|está (?:disponible|activ[oa])|se (?:encuentra|encontró|pudo .*))|ya no .*|ha (?:sido .*|caducado|expirado|tardado .*)|fue (?:eliminad[oa]|bloquead[oa])|está (?:bloquead[oa]|fuera de servicio)|tardó .*|encontró .*){_ADVICE}",
    r"página no (?:encontrada|disponible)|acceso (?:denegado|prohibido)|error interno(?: del servidor)?|se ha producido un error.*|servicio no disponible(?: temporalmente)?|demasiadas (?:solicitudes|peticiones)|tiempo de espera agotado.*|cargando(?:[.… ]+(?:por favor|espere|la página|página|contenido|datos).*)?|espere(?:,? por favor)?.*|su sesión ha (?:caducado|expirado).*|inicie sesión.*|verifique que .*",
    r"(?:很抱歉|抱歉|对不起)[ ,]?.{0,30}(?:下架|不存在|删除|出错|失败|无法|走丢).{0,20}",
    r"(?:您(?:要?(?:访问|查看|请求|找|浏览))的|该|此|本|当前)?(?:商品详情|商品|页面|链接|店铺|宝贝|服务器?|网页|内容|网站|系统|信息|请求)(?:信息|数据|内容)?(?:已被?|暂时|似乎|可能)?(?:不存在|走丢了|加载失败|打不开了?|已?下架|已?被?删除|已?失效|(?:被系统)?拦截|无法(?:访问|显示|打开)|开小差了|繁忙|超时|出错了?|异常|维护中|升级维护中|找不到了?|不可用|响应超时|未响应|没有响应|崩溃了?)(?: ?或不存在)?(?:[ ,].{0,24})?",
    r"(?:请求|访问|连接|网络)(?:过于频繁|超时|异常|错误|失败|被拒绝)(?:[ ,].{0,24})?|登录(?:已)?(?:过期|失效)(?:[ ,].{0,24})?|无权(?:访问|限).{0,12}|(?:正在)?加载中(?:[ ,].{0,12})?|请稍候|请(?:先)?(?:登录|完成(?:安全)?验证|验证).{0,20}|(?:安全)?验证(?:失败|中).{0,12}|服务器(?:内部)?错误.{0,12}|系统(?:繁忙|错误|异常|维护).{0,16}",
)

_EN_DO = r"(?:(?:kindly|please|you (?:must|need to|have to|should)|to (?:view|see|use|continue)[^,]*,)\s*)*(?:first )?(?:enable|turn on|switch on|activate|allow|re-?enable|unblock)"
_JS = r"(?:java ?script|\bjs\b|scripts?|scripting|skripte?|脚本)"
#: Notices that scripts are needed, whole.
SCRIPTS = (
    rf"{_EN_DO}\s+.*{_JS}.*|enable cookies and .*",
    # cut off before the word
    r"(?:enable|turn on|switch on|activate|allow) [\w ]{0,20}\.\.\.",
    r"(?:(?:kindly|please|you (?:must|need to|have to)|to (?:view|see|use) this [^,]*,)\s*)+(?:enab|turn|swit|activ|allo|re-?en|unbl)\w*[^.]{0,40}\.\.\.",
    rf".*{_JS} (?:is|are|has been) (?:disabled|turned off|required|needed|blocked|not (?:enabled|supported|available)).*|.*requires? (?:{_JS}|{_JS} to be).*|noscript.*|.*does not support {_JS}.*|.*needs? {_JS} (?:to|enabled).*",
    rf"(?:bitte |sie müssen |um fortzufahren |zuerst )+.*(?:{_JS}|java).*|.*{_JS}.*(?:aktivieren|einschalten|zulassen|benötigt|deaktiviert|erforderlich).*|für diese anwendung wird java.*|.*(?:aktivieren|erlauben) sie (?:{_JS}|java).*",
    rf"(?:merci d'|veuillez |vous devez |il faut )(?:d'abord )?(?:activ|autoris|réactiv|débloqu)\w*.*|(?:ce|cette|le) (?:site|page|application|boutique) nécessite (?:l'|les |java).*|(?:activez|autorisez) .*{_JS}.*",
    rf"(?:por favor,? |debe |tiene que |necesita )*(?:activ[ae]r?|habilit[ae]r?|habilite|permit[ae]|permitir|encender|encienda|desbloquear) .*(?:{_JS}|navegador).*|(?:por favor,? |debe |tiene que |necesita )+(?:activar|habilitar|permitir|encender).*|esta página requiere .*|este sitio (?:requiere|necesita) .*",
    r"(?:浏览前|继续前|访问前)?(?:请先?|您?(?:必须|需要|应)(?:您)?(?:先)?|需要您|需|先)?(?:在设置中)?(?:开启|启用|打开|允许|解除禁用|激活|启动|恢复)(?: ?cookie ?和?)? ?(?:浏览器)? ?(?:java ?scr?i?p?t?|js|脚本|cookie).{0,30}",
    r"(?:本站|本页|本店|此页|该网站|页面)(?:需要|须|必须)?(?:启用|开启|打开|使用)?(?:脚本|java ?script|js).{0,20}|检测到(?:您的)?(?:脚本|java ?script|js|浏览器).{0,24}|您的浏览器(?:不支持|已禁用|未启用|禁用了|关闭了).{0,24}|.{0,6}(?:java ?script|脚本)(?:已被禁用|被禁用|已禁用|未启用|不可用).{0,20}",
)
#: What every notice about scripts holds; a cheap look before the phrases are tried.
SCRIPTS_HINT = r"(?iu)java|script|skript|js|脚本|cookie|浏览器|检测到|\.\.\.|merci d'|veuillez|vous devez|il faut|nécessite|por favor|debe|tiene que|necesita|requiere|navegador"
#: Real texts about scripts and errors.
ABOUT = r"(?i)从入门|图书|手册|方案对比|options compared|explained|第 ?\d+ ?(?:版|期|讲)|compared|field guide|verstehen|comprendre|épisode|为什么"

_CODE = r"(?:(?:error|http(?: status)?|fehler|erreur|错误(?:代码|码)?|status|code)\s*)?[1-5]\d\d\s*[:,.-]?\s*"
_AFTER = r"[\s.!?。！？…]*(?:\s*\((?:error|http|fehler|erreur|错误(?:代码|码)?|código|code)?\s*\d{3}\)|\.*\s*ref\.?:?\s*[0-9a-f]{4,}|\s+\d{1,2}秒后.*)?"


def _whole(phrases: Sequence[str]) -> str:
    """A pattern that one of the phrases fills completely, besides an error code, a counter and punctuation."""
    return "(?iu)^[\\s\"'“「(\\[]*(?:" + _CODE + ")?(?:" + "|".join(phrases) + ")" + _AFTER + _COUNTER + _PUNCT + "[\\s\"'”」)\\]]*$"


def parts(text: Column) -> Column:
    """The text and, where it has several, its segments."""
    segments = F.split(text, r"\s+[|·–—-]\s+|\s*[|｜_]\s*|: (?=\p{L})")
    return F.when(F.size(segments) > 1, F.concat(F.array(text), segments)).otherwise(F.array(text))


def has_placeholder(text: Column) -> Column:
    """Whether a text holds an unfilled placeholder outside code spans and talk about templates."""
    visible = F.regexp_replace(text, CODE_SPAN, " ")
    dense = F.length(F.regexp_replace(visible, PLACEHOLDER, "")) <= 0.5 * F.length(visible)
    return text.rlike(PLACEHOLDER_HINT) & visible.rlike(PLACEHOLDER) & (dense | ~visible.rlike(CODE_TALK))


def residue_kind(text: Column, segments: Column | None = None) -> Column:
    """``placeholder``, ``mistake``, ``filler``, ``scripts``, ``error`` -- or null for content, blanks and null.

    ``text`` is expected in canonical form (see :mod:`loomstone.llm.lookalikes`); ``segments`` may hold its
    :func:`parts` where they are a column already.
    """
    segments = parts(text) if segments is None else segments
    fills = lambda phrases: F.exists(segments, lambda s: s.rlike(_whole(phrases)))
    about = text.rlike(ABOUT)
    return (
        F.when(text.isNull() | (F.trim(text) == ""), None)
        .when(has_placeholder(text), "placeholder")
        .when(fills(MISTAKE), "mistake")
        .when(fills(FILLER), "filler")
        .when(text.rlike(SCRIPTS_HINT) & fills(SCRIPTS) & ~about, "scripts")
        .when(fills(ERROR) & ~about, "error")
    )


def find(df: DataFrame, key: str, field: str) -> DataFrame:
    """``key``, ``text`` (canonical) and ``kind`` of every row whose text is wholly or partly no content.

    Null and blank texts are never reported; repeated rows are reported each; other columns are not read. Very long
    texts are searched whole.
    """
    wide = lookalikes.canonical(df, [key], [field])
    rows = once(wide, {"text": F.col(f"`{field + lookalikes.SUFFIX}`")}, [key])
    rows = once(rows, {"_parts": parts(F.col("text"))}, [key, "text"])
    return once(rows, {"kind": residue_kind(F.col("text"), F.col("_parts"))}, [key, "text"]).where(F.col("kind").isNotNull())
