"""Labelled pages for the main-text operator: layouts in which the content stands between « and ».

``{p}`` is a paragraph's worth of words, ``{s}`` a sentence, ``{l}`` a link of two words. Written for this purpose;
they differ in how content and everything else are marked, nested and left unclosed.
"""

LAYOUTS = (
    "<html><head><title>w w</title></head><body><nav><ul><li>{l}</li><li>{l}</li><li>{l}</li></ul></nav>«<article><h1>{s}</h1><p>{p}</p><p>{p}</p></article>»<footer>{s}</footer></body></html>",
    "<body><header><h2>w w</h2>{l}{l}</header>«<main><h1>{s}</h1><p>{p}</p><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul><p>{p}</p></main>»<aside><h3>w w</h3><ul><li>{l}</li><li>{l}</li></ul></aside><footer><p>{s}</p>{l}</footer></body>",
    "<body><div class='navbar'>{l}{l}{l}</div><div class='content'>«<h1>{s}</h1><p>{p}</p><blockquote>{p}</blockquote><p>{p}</p>»</div><div class='sidebar'><p>{s}</p><ul><li>{l}</li></ul></div><div id='footer'>{s}</div></body>",
    "<body><div id='menu'><table><tr><td>{l}</td><td>{l}</td></tr></table></div>«<div class='post-body'><h2>{s}</h2><p>{p}</p><pre>{s}</pre><p>{p}</p></div>»<div class='comments'><div class='comment'><p>{s}</p></div><div class='comment'><p>{p}</p></div></div></body>",
    "<body><div>{l}{l}</div><div class='wrapper has-sidebar'><div class='entry-content'>«<h1>{s}</h1><p>{p}<p>{p}<h3>w w</h3><p>{p}»</div><div class='widget'><h4>w</h4><p>{s}</p></div></div><p>copyright w w all rights reserved</p></body>",
    "<body><form><div class='topbar'>{l}<span>w</span></div><div class='article'>«<h1>{s}</h1><p>{p}</p><p>{p}</p><p>{p}</p>»</div><div>{l}{l}{l}</div></form></body>",
    "<body class='page ad-free'><div role='banner'><p>{s}</p></div><div class='text'>«<p>{p}</p><p>{p}</p><table><tr><td>{s}</td><td>w w</td></tr><tr><td>{s}</td><td>w</td></tr></table><p>{p}</p>»</div><form><label>w w</label><p>{s}</p></form></body>",
    "<body>«<article><header><h1>{s}</h1></header><p>{p}</p>»<div class='ad'><p>{s}</p></div>«<p>{p}</p><figure><figcaption>{s}</figcaption></figure><p>{p}</p>»<section class='share'><p>{s}</p></section></article><section id='comments'><article><p>{p}</p></article></section><footer>{l}</footer></body>",
    "<body><div class='cookie-notice'><p>{s}</p>{l}</div><div class='layout sidebar-left'><aside><p>{s}</p></aside><div class='story'>«<h1>{s}</h1><p>{p}</p><p>{p}</p>»</div></div><p>subscribe to our newsletter w w</p><div>{l}{l}</div></body>",
    "<body><center><font><b>w w</b></font></center><table><tr><td>{l}<br>{l}<br>{l}</td><td>«<font><p>{p}<p>{p}<p>{p}</font>»</td></tr></table><center>{l} {l}</center></body>",
    "<body><div><span>w</span><span>{l}</span></div>«<section><h2>{s}</h2><div>{p}</div><div>{p}</div><ol><li>{p}</li><li>{p}</li></ol></section>»<section><h3>w w</h3><ul><li>{l}</li><li>{l}</li><li>{l}</li></ul></section><div class='promo'><p>{s}</p></div></body>",
    "<body><nav>{l}{l}<div class='main-column share-enabled'>«<article><h1>{s}</h1><p>{p}</p><p>{p}</p></article>»</div><div class='related'><h3>w w</h3><p>{s}</p>{l}</div><menu><li>{l}</li></menu></body>",
    "<body><div class='popup'><p>{s}</p></div><dialog><p>{s}</p></dialog>«<div><h1>{s}</h1><div><p>{p}</p></div><dl><dt>w w</dt><dd>{p}</dd><dt>w</dt><dd>{p}</dd></dl></div>»<fieldset><p>{s}</p></fieldset><address>w w</address></body>",
    "<body><header><div class='logo'>w</div><p>{s}</p></header><div class='content-with-sidebar'>«<p>{p}</p><p>{p}</p><p>{p}</p>»<div class='sidebar'><p>{s}</p><p>{s}</p></div></div><p>sign up for updates w w w</p></body>",
    "<body><p>{l} | {l} | {l}</p>«<h1>{s}</h1><p>{p} {l} {s}</p><p>{p}</p><h2>w w</h2><p>{s} {l} {s}</p><p>{p}</p>»<p>{l} | {l}</p><p>follow us w w</p><div class='footer-links'><p>{s}</p></div></body>",
    "<body><ul><li>{l}</li><li>{l}</li></ul><div class='no-sidebar post'>«<h1>{s}</h1><p>{p}</p>»<aside><p>{s}</p></aside>«<p>{p}</p>»<form><p>{s}</p></form></div><div id='disqus'><p>{p}</p><p>{s}</p></div></body>",
    "<body><nav><b>w w</b><span>w w w</span></nav><menu><li>w w</li><li>w w</li></menu>«<div><h3>{s}</h3><p>{s}</p><p>{p}</p><h4>w w</h4><p>{p}</p></div>»<nav>{s}</nav><footer>{s}</footer></body>",
    "<body><menu>w w w</menu><div>{l}</div>«<h2>{s}</h2><p>{s} {l} {s} {l} {s}</p><p>{l} {s} {l} {s}</p><p>{p} <span>w w</span> <em>w</em> {s}</p>»<ul><li>{l}</li></ul><nav>w w</nav><menu><li>{s}</li></menu></body>",
    "<body>«<div><h3>{s}</h3><div><span>{p}</span></div><div><span>{p}</span><br>{p}</div></div>»<fieldset>w w w</fieldset><dialog>{s}</dialog><menu>{s}</menu><address>w w</address></body>",
    "<body><ul class='menu'><li>w</li><li>w</li></ul><div id='content'>«<h1>{s}</h1><h3>w w</h3><p>{p}</p><h4>w w</h4><ul><li>{s}</li></ul><p>{p}</p>»<nav><h3>w</h3><p>w w</p></nav></div><div class='footer'>{s}</div></body>",
    "<body><div><strong>w</strong> <i>w w</i></div>«<h1>{s}</h1><p><b>w w</b> {p} <i>w</i> <strong>w w</strong> <em>w</em> {s} <code>w</code><br>{s}<br>{s}</p><p><span>{p}</span> <b>w</b> <u>w</u></p>»<p><i>{l}</i></p></body>",
    "<body><b>w</b><br><i>w</i><br>«<h2><b>{s}</b></h2><p><strong>{s}</strong><br>{p}</p><p><i>{s}</i> {p} <b>w w</b> <span>w</span> <sup>w</sup></p>»<span>{l}</span><span>w</span></body>",
)
