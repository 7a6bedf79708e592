"""Hand-labelled pages in common layouts, written for this library.

What stands between ``<!--main-->`` and ``<!--/main-->`` is main content, all else is not;
a page may have several such stretches. The weights of ``html_extract`` are learned here.
"""

WORDS = "one two three four five six seven eight nine ten eleven twelve"

PAGES = [
    f"""<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li>
<li><a href="/c">About us</a></li></ul></nav><div class="ad">Buy now {WORDS}</div><article><!--main--><h1>Head line</h1>
<p>{WORDS} {WORDS}</p><p>{WORDS} <b>bold</b> <a href="/x">a link</a> {WORDS}</p><!--/main--></article>
<footer>&copy; site {WORDS}</footer></body></html>""",
    f"""<body><header class="masthead"><a href="/">Logo</a><p>Slogan {WORDS}</p></header><div id="menu"><a href="/1">One</a>
<a href="/2">Two</a></div><main><article class="post"><!--main--><h1>Title</h1><p>{WORDS} {WORDS}</p>
<blockquote>{WORDS}</blockquote><ul><li>{WORDS}</li><li>{WORDS}</li></ul><pre>{WORDS}</pre><!--/main-->
<div class="share"><a href="#">Share this</a></div></article><section class="comments"><p>Comments</p>
<div class="comment"><p>{WORDS}</p></div><div class="comment"><p>{WORDS} {WORDS}</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">{WORDS}</a></li></ul></aside><footer><p>{WORDS}</p></footer></body>""",
    f"""<body><div id="header"><h1>Site name</h1><p>{WORDS}</p></div><div class="nav navbar navigation topbar"><ul><li>{WORDS}</li></ul></div>
<div id="content"><!--main--><h2>Head</h2><p>{WORDS} {WORDS}</p><p>{WORDS}</p><table><tr><td>{WORDS}</td></tr></table>
<p><em>{WORDS}</em></p><!--/main--></div><div id="sidebar"><p>{WORDS}</p><p>{WORDS}</p></div>
<div id="footer"><p>Copyright {WORDS}</p></div></body>""",
    f"""<body><div class="cookie-notice notice banner">We use cookies {WORDS} <button>OK</button></div><form class="search" action="/s">
<label>Search {WORDS}</label><input type="text"><select><option>All</option><option>Some</option></select></form>
<div class="entry-content article-body post-content"><!--main--><p>{WORDS} {WORDS}</p><h2>Part</h2><p>{WORDS}</p>
<ol><li>{WORDS}</li></ol><!--/main--></div><div id="comments" class="comments"><p>{WORDS}</p><p>{WORDS}</p></div>
<form id="respond"><p>Leave a reply {WORDS}</p><textarea></textarea></form></body>""",
    f"""<body><div role="navigation"><a href="/a">A</a> <a href="/b">B</a></div><div class="breadcrumb breadcrumbs crumbs">{WORDS} <a href="/">Home</a> /
<a href="/n">News</a></div><div role="main" class="main"><div class="story text"><!--main--><p>{WORDS}</p><p>{WORDS} {WORDS}</p>
<figure><figcaption>{WORDS}</figcaption></figure><!--/main--><div class="ads advert advertisement sponsored promo"><p>{WORDS}</p></div><!--main--><p>{WORDS}
{WORDS}</p><!--/main--></div></div><div class="related popular widget"><h4>More</h4><p>{WORDS}</p></div>
<div class="newsletter subscribe signup"><p>Get our letter {WORDS}</p></div><div class="social share">Follow us {WORDS}</div></body>""",
    f"""<body><div class="alert warning popup modal overlay"><p>{WORDS}</p></div><div class="menu"><ul><li>Home</li><li>Shop</li></ul></div>
<section class="article"><!--main--><h1>Name</h1><section><h2>First</h2><p>{WORDS} {WORDS}</p></section><section><h2>Next</h2>
<dl><dt>{WORDS}</dt><dd>{WORDS}</dd></dl><p>{WORDS}</p></section><!--/main--></section><div class="disqus discussion replies reply
comments"><p>{WORDS}</p></div><div class="copyright legal"><p>{WORDS}</p></div><noscript><p>{WORDS}</p></noscript></body>""",
    f"""<body><div class="page"><div class="container"><nav class="toc pager pagination"><p>{WORDS}</p></nav><div>{WORDS} {WORDS}</div>
<div><div class="list wrapper box row col section"><p>{WORDS} {WORDS} {WORDS}</p></div></div><div class="list wrapper box row col section"><!--main--><p>{WORDS}</p><p>{WORDS}
{WORDS}</p><div>{WORDS}</div><p>{WORDS} <span>{WORDS}</span> <code>{WORDS}</code></p><!--/main--></div>
<aside><p>{WORDS}</p></aside></div></div><div class="login register"><form><p>{WORDS}</p></form></div></body>""",
    f"""<body><menu><li>{WORDS}</li></menu><dialog><p>{WORDS}</p></dialog><div class="content body"><!--main--><h1>T</h1><div>{WORDS}<br>{WORDS}</div><div>{WORDS}</div>
<h3>Sub {WORDS}</h3><h4>{WORDS}</h4><div><span>{WORDS}</span></div><!--/main--></div><div class="sponsor banner ad ads"><div>{WORDS}</div></div>
<iframe>{WORDS}</iframe><button>{WORDS}</button><div class="footer"><div>{WORDS}</div></div></body>""",
    f"""<body><header><h1>Brand</h1><p>{WORDS}</p></header><article><!--main--><h1>Name</h1><p>{WORDS} {WORDS}</p><!--/main--><aside><p>{WORDS}</p></aside><!--main-->
<p>{WORDS} {WORDS}</p><!--/main--><footer><p>{WORDS}</p></footer><nav><a href="/n">{WORDS}</a></nav><form><p>{WORDS}</p></form></article></body>""",
]
