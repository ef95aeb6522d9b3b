"""Signatures of licences, written by hand: what their texts, notices and headers say.

A line is ``label: expression``. Words of an expression may stand apart by anything that is no word; ``*`` is up
to eight words of any kind; a word may hold a regular expression over lower-case letters and digits; a word that
ends in ``?`` after a bracket may be missing.
"""

#: Clauses that stand in the body of one licence alone: priority 90.
BODY = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the)? software to deal in the software without restriction
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit: in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software * without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
x11: except as contained in this notice the name of the x consortium shall not be used in advertising
x11: except as contained in this notice the names? of * shall not be used in advertising or otherwise to promote the sale
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that
isc: the software is provided as is and (the)? (author|isc|internet) * disclaims? all warranties with regard to this software
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd: permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd-2-clause: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by
bsd-3-clause: neither the names? of * nor the names of (its|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause: the names? of * may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear: no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e
bsd: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd: this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
apache-2.0: subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-2.0: terms and conditions for use reproduction and distribution 1 definitions
apache-2.0: you must cause any modified files to carry prominent notices stating that you changed the files
apache-2.0: licen[sc]e shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9
apache-2.0: if the work includes a notice text file as part of its distribution
apache-1.1: the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by the apache software foundation
apache-1.1: products derived from this software may not be called apache nor may apache appear in their name
apache-1.0: this product includes software developed by the apache group for use in the apache http server project
gpl-1.0: the general public licen[sc]e applies to the free software foundation s software and to any other program whose authors commit to using it
gpl-2.0: you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
gpl-2.0: this licen[sc]e applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public licen[sc]e
gpl-2.0: activities other than copying distribution and modification are not covered by this licen[sc]e
gpl-2.0: you may not copy modify sublicen[sc]e or distribute the program except as expressly provided under this licen[sc]e
gpl-2.0: gnu general public licen[sc]e version 2 june 1991
gpl-3.0: gnu general public licen[sc]e version 3 29 june 2007
gpl-3.0: this licen[sc]e refers to version 3 of the gnu general public licen[sc]e
gpl-3.0: the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl-3.0: to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
gpl-3.0: each contributor grants you a non exclusive worldwide royalty free patent licen[sc]e under the contributor s essential patent claims
lgpl-2.0: gnu library general public licen[sc]e version 2 june 1991
lgpl-2.1: gnu lesser general public licen[sc]e version 2 1 february 1999
lgpl-2.1: this is the first released version of the lesser gpl
lgpl-2.1: a work that uses the library
lgpl-3.0: this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e
lgpl-3.0: gnu lesser general public licen[sc]e version 3 29 june 2007
lgpl-3.0: an application is any work that makes use of an interface provided by the library but which is not otherwise based on the library
agpl-3.0: gnu affero general public licen[sc]e version 3 19 november 2007
agpl-3.0: if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-1.0: affero general public licen[sc]e version 1 march 2002
gfdl: the purpose of this licen[sc]e is to make a manual textbook or other functional and useful document free
gfdl-1.3: gnu free documentation licen[sc]e version 1 3 3 november 2008
gfdl-1.2: gnu free documentation licen[sc]e version 1 2 november 2002
gfdl-1.1: gnu free documentation licen[sc]e version 1 1 march 2000
mpl-1.0: mozilla public licen[sc]e version 1 0 1 definitions
mpl-1.1: initial developer means the individual or entity identified as the initial developer in the source code notice
mpl-1.1: the initial developer hereby grants you a world wide royalty free non exclusive licen[sc]e subject to third party intellectual property claims
mpl-2.0: each contributor hereby grants you a world wide royalty free non exclusive licen[sc]e
mpl-2.0: covered software means source code form to which the initial contributor has attached the notice in exhibit a
mpl-2.0: mozilla public licen[sc]e version 2 0 1 definitions
epl-1.0: eclipse public licen[sc]e v 1 0 the accompanying program is provided under the terms of this eclipse public licen[sc]e
epl-2.0: eclipse public licen[sc]e v 2 0 the accompanying program is provided under the terms of this eclipse public licen[sc]e
epl: the accompanying program is provided under the terms of this eclipse public licen[sc]e
cpl-1.0: the accompanying program is provided under the terms of this common public licen[sc]e
ipl-1.0: the accompanying program is provided under the terms of this ibm public licen[sc]e
cddl-1.0: common development and distribution licen[sc]e cddl version 1 0
cddl-1.1: common development and distribution licen[sc]e cddl version 1 1
cddl: modifications means the source code and executable form of any of the following a any file that results from an addition to
eupl-1.2: european union public licen[sc]e v 1 2 eupl the european union 2007 2016
eupl: this european union public licen[sc]e the eupl applies to the work
artistic-1.0: the intent of this document is to state the conditions under which a package may be copied
artistic-2.0: this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-2.0: you are permitted to use the standard version and create and use modified versions for any purpose without restriction
ofl-1.1: the goals of the open font licen[sc]e ofl are to stimulate worldwide development of collaborative font projects
ofl-1.1: neither the font software nor any of its individual components in original or modified versions may be sold by itself
bsl-1.0: permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
zlib: the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng: the png reference library is supplied as is
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
wtfpl: do what the fuck you want to public licen[sc]e
wtfpl: you just do what the fuck you want to
beerware: as long as you retain this notice you can do whatever you want with this stuff
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files * to deal with the software without restriction
ncsa: university of illinois ncsa open source licen[sc]e
psf-2.0: psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e
psf-2.0: this licen[sc]e agreement is between the python software foundation
python: this licen[sc]e agreement is between (beopen com|the corporation for national research initiatives)
php-3.01: the name php must not be used to endorse or promote products derived from this software
ruby: you may make and give away verbatim copies of the source form of the software without restriction
vim: there are no restrictions on distributing unmodified copies of vim
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
ssleay: this product includes cryptographic software written by eric young
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement of third party rights
icu: permission is hereby granted * provided that the above copyright notice s and this permission notice appear in all copies of the software
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ijg: this software is based in part on the work of the independent jpeg group
freetype: portions of this software are copyright * the freetype project
w3c: permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
ms-pl: each contributor grants you a non exclusive worldwide royalty free copyright licen[sc]e to reproduce its contribution
ms-pl: microsoft public licen[sc]e ms pl this licen[sc]e governs use of the accompanying software
ms-rl: microsoft reciprocal licen[sc]e ms rl this licen[sc]e governs use of the accompanying software
osl-3.0: licensed under the open software licen[sc]e version 3 0
afl-3.0: licensed under the academic free licen[sc]e version 3 0
upl-1.0: the universal permissive licen[sc]e upl version 1 0
cc0-1.0: the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0: affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights
cc-by-4.0: by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public licen[sc]e
cc-by-sa-4.0: by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public licen[sc]e
cc-by-nc-4.0: by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public licen[sc]e
cc-by: you are free to share copy and redistribute the material in any medium or format
cc-by: you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e as the original
cc-by-nc: you may not use the material for commercial purposes
cc-by-nd: if you remix transform or build upon the material you may not distribute the modified material
odbl-1.0: open database licen[sc]e odbl preamble the open database licen[sc]e is a licen[sc]e agreement
odbl-1.0: this * is made available under the open database licen[sc]e
odc-by-1.0: open data commons attribution licen[sc]e
pddl-1.0: open data commons public domain dedication and licen[sc]e
sspl-1.0: if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2.0: you may not provide the software to third parties as a hosted or managed service
commons-clause: without limiting other conditions in the licen[sc]e the grant of rights under the licen[sc]e will not include
json: the software shall be used for good not evil
wxwindows: as a special exception the copyright holders of this library give permission for additional uses of the text contained in this release
gcc-exception: you have permission to propagate a work of target code formed by combining the runtime library with independent modules
classpath-exception: as a special exception the copyright holders of this library give you permission to link this library with independent modules
llvm-exception: as an exception if as a result of your compiling your source code portions of this software are embedded into an object form
openrail: use restrictions as set forth in attachment a
llama: you will not use the llama materials or any output or results of the llama materials to improve any other large language model
"""

#: Notices that a file carries to name its licence: priority 80.
NOTICE = """
apache-2.0: licensed under the apache licen[sc]e version 2 0 (the)? licen[sc]e you may not use this file except in compliance with the licen[sc]e
apache-2.0: you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at http(s)? www apache org licenses license 2 0
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-2.0: licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache-2.0: apache org licenses license 2 0
gpl-1.0-or-later: it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 1 or at your option any later version
gpl-2.0-or-later: it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-3.0-or-later: it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-2.0: it under the terms of the gnu general public licen[sc]e version 2 as published by the free software foundation
gpl-3.0: it under the terms of the gnu general public licen[sc]e version 3 as published by the free software foundation
gpl: it under the terms of the gnu general public licen[sc]e as published by the free software foundation
gpl: you should have received a copy of the gnu general public licen[sc]e along with this (program|software|file|library|package)
gpl: see the gnu general public licen[sc]e for more details
gpl-2.0: gnu org licenses (old licenses)? gpl 2 0
gpl-3.0: gnu org licenses gpl 3 0
lgpl-2.0-or-later: it under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
lgpl-2.1-or-later: it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
lgpl-3.0-or-later: it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
lgpl: it under the terms of the gnu (lesser|library) general public licen[sc]e as published by the free software foundation
lgpl: you should have received a copy of the gnu (lesser|library) general public licen[sc]e along with this (program|software|file|library|package)
lgpl: see the gnu (lesser|library) general public licen[sc]e for more details
lgpl-2.1: gnu org licenses (old licenses)? lgpl 2 1
lgpl-3.0: gnu org licenses lgpl 3 0
agpl-3.0-or-later: it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
agpl: it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation
agpl: you should have received a copy of the gnu affero general public licen[sc]e along with this
agpl-3.0: gnu org licenses agpl 3 0
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
mpl-1.1: the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2.0: this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2.0: if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0: mozilla org mpl 2 0
epl-1.0: which accompanies this distribution and is available at http(s)? www eclipse org legal epl v10
epl-2.0: which is available at http(s)? www eclipse org legal epl 2 0
epl: this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
cddl: the contents of this file are subject to the terms of the common development and distribution licen[sc]e
bsl-1.0: distributed under the boost software licen[sc]e version 1 0
bsl-1.0: boost org license 1 0 txt
mit: opensource org licenses mit( license)?
mit: (licensed|released|distributed|available) under the (terms of the)? mit licen[sc]e
mit: use of this source code is governed by an mit style licen[sc]e
mit-or-apache-2.0: licensed under either of apache licen[sc]e version 2 0 * or mit licen[sc]e
bsd: use of this source code is governed by a bsd style licen[sc]e
bsd: (licensed|released|distributed|available) under the (terms of the)? bsd licen[sc]e
bsd-2-clause: opensource org licenses bsd 2 clause
bsd-3-clause: opensource org licenses bsd 3 clause
bsd-2-clause: (simplified|two clause|2 clause) bsd
bsd-3-clause: (new|revised|modified|three clause|3 clause) bsd
isc: opensource org licenses isc
wtfpl: wtfpl net
zlib: (licensed|released|distributed) under the zlib libpng licen[sc]e
unlicense: for more information please refer to http(s)? unlicense org
cc0-1.0: creativecommons org publicdomain zero 1 0
public-domain: creativecommons org publicdomain mark 1 0
cc-by-1.0: creativecommons org licenses by 1 0
cc-by-2.0: creativecommons org licenses by 2 0
cc-by-2.5: creativecommons org licenses by 2 5
cc-by-3.0: creativecommons org licenses by 3 0
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-sa-1.0: creativecommons org licenses by sa 1 0
cc-by-sa-2.0: creativecommons org licenses by sa 2 0
cc-by-sa-2.5: creativecommons org licenses by sa 2 5
cc-by-sa-3.0: creativecommons org licenses by sa 3 0
cc-by-sa-4.0: creativecommons org licenses by sa 4 0
cc-by-nc-2.0: creativecommons org licenses by nc 2 0
cc-by-nc-3.0: creativecommons org licenses by nc 3 0
cc-by-nc-4.0: creativecommons org licenses by nc 4 0
cc-by-nd-3.0: creativecommons org licenses by nd 3 0
cc-by-nd-4.0: creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0: creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0: creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
cc-by: this (work|article|document|text|content|page) is licensed under a creative commons attribution
cc-by: open access article distributed under the terms of the creative commons attribution licen[sc]e
cc-by-sa: text is available under the creative commons attribution sharealike licen[sc]e
cc-by-nc: open access article distributed under the terms of the creative commons attribution non ?commercial licen[sc]e
public-domain: this (work|file|program|software|document) (is|has been) (placed )?in the public domain
public-domain: (released|placed|dedicated) (in)?to the public domain
public-domain: no rights reserved
perl: (you can|you may) redistribute it and or modify it under the same terms as perl itself
ruby: (you can|you may) redistribute it and or modify it under the same terms as ruby
php: this source file is subject to version 3 01? of the php licen[sc]e
python: distributed under the same licen[sc]e as python
artistic: (licensed|released|distributed|available) under the (terms of the)? artistic licen[sc]e
ofl-1.1: this font software is licensed under the sil open font licen[sc]e version 1 1
ofl-1.1: scripts sil org ofl
eupl: licensed under the eupl
odbl-1.0: opendatacommons org licenses odbl
odc-by-1.0: opendatacommons org licenses by
pddl-1.0: opendatacommons org licenses pddl
ogl-3.0: contains public sector information licensed under the open government licen[sc]e v3 0
ogl: licensed under the open government licen[sc]e
commercial: (you need|requires?) a commercial licen[sc]e
commercial: use is subject to licen[sc]e terms
commercial: end user licen[sc]e agreement
commercial: this software is (proprietary|confidential) and may not be
proprietary: unauthori[sz]ed (copying|use|reproduction|distribution) (of|or) * is (strictly )?prohibited
proprietary: no part of this (publication|book|work|document) may be reproduced
proprietary: may not be (reproduced|copied|redistributed|published|broadcast) * without * (prior )?(written )?(permission|consent)
proprietary: for (personal|private|internal|non commercial|educational) use only
proprietary: do not (copy|distribute|redistribute|reproduce) without permission
proprietary: proprietary and confidential
proprietary: trade secrets? and confidential
"""
