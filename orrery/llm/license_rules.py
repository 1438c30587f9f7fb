"""Signature rules of the license scan, in order: ``priority | license | keywords | regex``.

A space in a regex stands for white space with comment signs, so that wrapped
and commented notices match. Every match contains all the keywords (lower
case); texts without them never reach the regex. Priorities: 90 tags, 80 grant
sentences, 70 addresses, 60 names with versions, 50 short names, 40 families
without a version, 20 general notices.

Copyright notices have two rules each: the last two run on to the end of the
line or to the next notice in it; the ones of 80 signs hold where a license in
the rest of the line overlaps the long match.
"""

RULES = r"""
90 | MIT | spdx,mit | SPDX-License-Identifier: ?MIT\b(?!-)
90 | MIT-0 | spdx,mit-0 | SPDX-License-Identifier: ?MIT-0\b
90 | Apache-2.0 | spdx,apache-2.0 | SPDX-License-Identifier: ?Apache-2\.0\b
90 | Apache-1.1 | spdx,apache-1.1 | SPDX-License-Identifier: ?Apache-1\.1\b
90 | BSD-2-Clause | spdx,bsd-2-clause | SPDX-License-Identifier: ?BSD-2-Clause\b
90 | BSD-3-Clause | spdx,bsd-3-clause | SPDX-License-Identifier: ?BSD-3-Clause\b
90 | BSD-4-Clause | spdx,bsd-4-clause | SPDX-License-Identifier: ?BSD-4-Clause\b
90 | 0BSD | spdx,0bsd | SPDX-License-Identifier: ?0BSD\b
90 | ISC | spdx,isc | SPDX-License-Identifier: ?ISC\b
90 | GPL-1.0-only | spdx,gpl-1.0 | SPDX-License-Identifier: ?GPL-1\.0(?:-only)?(?![-+\w])
90 | GPL-2.0-only | spdx,gpl-2.0 | SPDX-License-Identifier: ?GPL-2\.0(?:-only)?(?![-+\w])
90 | GPL-2.0-or-later | spdx,gpl-2.0 | SPDX-License-Identifier: ?GPL-2\.0(?:\+|-or-later)
90 | GPL-3.0-only | spdx,gpl-3.0 | SPDX-License-Identifier: ?GPL-3\.0(?:-only)?(?![-+\w])
90 | GPL-3.0-or-later | spdx,gpl-3.0 | SPDX-License-Identifier: ?GPL-3\.0(?:\+|-or-later)
90 | LGPL-2.0-only | spdx,lgpl-2.0 | SPDX-License-Identifier: ?LGPL-2\.0(?:-only)?(?![-+\w])
90 | LGPL-2.0-or-later | spdx,lgpl-2.0 | SPDX-License-Identifier: ?LGPL-2\.0(?:\+|-or-later)
90 | LGPL-2.1-only | spdx,lgpl-2.1 | SPDX-License-Identifier: ?LGPL-2\.1(?:-only)?(?![-+\w])
90 | LGPL-2.1-or-later | spdx,lgpl-2.1 | SPDX-License-Identifier: ?LGPL-2\.1(?:\+|-or-later)
90 | LGPL-3.0-only | spdx,lgpl-3.0 | SPDX-License-Identifier: ?LGPL-3\.0(?:-only)?(?![-+\w])
90 | LGPL-3.0-or-later | spdx,lgpl-3.0 | SPDX-License-Identifier: ?LGPL-3\.0(?:\+|-or-later)
90 | AGPL-3.0-only | spdx,agpl-3.0 | SPDX-License-Identifier: ?AGPL-3\.0(?:-only)?(?![-+\w])
90 | AGPL-3.0-or-later | spdx,agpl-3.0 | SPDX-License-Identifier: ?AGPL-3\.0(?:\+|-or-later)
90 | MPL-1.1 | spdx,mpl-1.1 | SPDX-License-Identifier: ?MPL-1\.1\b
90 | MPL-2.0 | spdx,mpl-2.0 | SPDX-License-Identifier: ?MPL-2\.0\b
90 | EPL-1.0 | spdx,epl-1.0 | SPDX-License-Identifier: ?EPL-1\.0\b
90 | EPL-2.0 | spdx,epl-2.0 | SPDX-License-Identifier: ?EPL-2\.0\b
90 | CDDL-1.0 | spdx,cddl-1.0 | SPDX-License-Identifier: ?CDDL-1\.0\b
90 | CDDL-1.1 | spdx,cddl-1.1 | SPDX-License-Identifier: ?CDDL-1\.1\b
90 | BSL-1.0 | spdx,bsl-1.0 | SPDX-License-Identifier: ?BSL-1\.0\b
90 | BUSL-1.1 | spdx,busl-1.1 | SPDX-License-Identifier: ?BUSL-1\.1\b
90 | Zlib | spdx,zlib | SPDX-License-Identifier: ?Zlib\b
90 | Unlicense | spdx,unlicense | SPDX-License-Identifier: ?Unlicense\b
90 | WTFPL | spdx,wtfpl | SPDX-License-Identifier: ?WTFPL\b
90 | CC0-1.0 | spdx,cc0-1.0 | SPDX-License-Identifier: ?CC0-1\.0\b
90 | CC-BY-3.0 | spdx,cc-by-3.0 | SPDX-License-Identifier: ?CC-BY-3\.0\b
90 | CC-BY-4.0 | spdx,cc-by-4.0 | SPDX-License-Identifier: ?CC-BY-4\.0\b
90 | CC-BY-SA-3.0 | spdx,cc-by-sa-3.0 | SPDX-License-Identifier: ?CC-BY-SA-3\.0\b
90 | CC-BY-SA-4.0 | spdx,cc-by-sa-4.0 | SPDX-License-Identifier: ?CC-BY-SA-4\.0\b
90 | CC-BY-NC-4.0 | spdx,cc-by-nc-4.0 | SPDX-License-Identifier: ?CC-BY-NC-4\.0\b
90 | CC-BY-ND-4.0 | spdx,cc-by-nd-4.0 | SPDX-License-Identifier: ?CC-BY-ND-4\.0\b
90 | CC-BY-NC-SA-4.0 | spdx,cc-by-nc-sa-4.0 | SPDX-License-Identifier: ?CC-BY-NC-SA-4\.0\b
90 | CC-BY-NC-ND-4.0 | spdx,cc-by-nc-nd-4.0 | SPDX-License-Identifier: ?CC-BY-NC-ND-4\.0\b
90 | Artistic-2.0 | spdx,artistic-2.0 | SPDX-License-Identifier: ?Artistic-2\.0\b
90 | PSF-2.0 | spdx,psf-2.0 | SPDX-License-Identifier: ?PSF-2\.0\b
90 | OFL-1.1 | spdx,ofl-1.1 | SPDX-License-Identifier: ?OFL-1\.1\b
90 | EUPL-1.1 | spdx,eupl-1.1 | SPDX-License-Identifier: ?EUPL-1\.1\b
90 | EUPL-1.2 | spdx,eupl-1.2 | SPDX-License-Identifier: ?EUPL-1\.2\b
90 | SSPL-1.0 | spdx,sspl-1.0 | SPDX-License-Identifier: ?SSPL-1\.0\b
90 | AFL-3.0 | spdx,afl-3.0 | SPDX-License-Identifier: ?AFL-3\.0\b
90 | OSL-3.0 | spdx,osl-3.0 | SPDX-License-Identifier: ?OSL-3\.0\b
90 | NCSA | spdx,ncsa | SPDX-License-Identifier: ?NCSA\b
90 | MS-PL | spdx,ms-pl | SPDX-License-Identifier: ?MS-PL\b
90 | MS-RL | spdx,ms-rl | SPDX-License-Identifier: ?MS-RL\b
90 | PostgreSQL | spdx,postgresql | SPDX-License-Identifier: ?PostgreSQL\b
90 | X11 | spdx,x11 | SPDX-License-Identifier: ?X11\b
90 | BlueOak-1.0.0 | spdx,blueoak | SPDX-License-Identifier: ?BlueOak-1\.0\.0\b
90 | MulanPSL-2.0 | spdx,mulanpsl | SPDX-License-Identifier: ?MulanPSL-2\.0\b
90 | other-tag | spdx,identifier | SPDX-License-Identifier: ?[A-Za-z0-9][A-Za-z0-9.+-]*(?: (?:AND|OR|WITH) [A-Za-z0-9][A-Za-z0-9.+-]*)*
80 | MIT | permission,granted,charge,obtaining | Permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files
80 | MIT | notice,substantial,portions | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
80 | MIT-0 | permission,granted,charge,without | Permission is hereby granted, free of charge, .{0,300}?without restriction.{0,260}?to do so\.(?! ?The above)(?=.{0,40}THE SOFTWARE IS PROVIDED)
80 | MIT | licensed,mit | licensed under (?:the )?(?:terms of (?:the )?)?MIT(?: License)?\b
80 | MIT | under,mit | (?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?MIT(?: License)?\b
80 | ISC | permission,modify,purpose,fee | Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
80 | X11 | permission,documentation,purpose,fee | Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee
80 | HPND | permission,documentation,purpose | Permission to use, copy, modify,? (?:and )?distribute this software and its documentation for any purpose
80 | Apache-2.0 | licensed,apache,version | licensed under the Apache License, ?Version 2\.0
80 | Apache-2.0 | under,apache | (?:licensed|released|distributed|available) under (?:the )?Apache(?: License)?,? (?:v|version )?2(?:\.0)?\b
80 | Apache-2.0 | compliance,license | you may not use this (?:file|work|software) except in compliance with the License
80 | Apache-2.0 | distributed,basis,warranties,conditions | distributed on an "?AS IS"? BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND
80 | Apache-1.1 | apache,foundation,includes | This product includes software developed by the Apache Software Foundation
80 | BSD-2-Clause | redistribution,source,binary,permitted | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
80 | BSD-3-Clause | neither,contributors,endorse | Neither the names? of (?:(?!Neither the names? of).)+? nor the names of (?:its|their|any) contributors may be used to endorse or promote
80 | BSD-4-Clause | advertising,materials | All advertising materials mentioning features or use of this software must display the following acknowledge?ment
80 | BSD-2-Clause | under,bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:2-clause|simplified|FreeBSD) BSD(?: License)?
80 | BSD-3-Clause | under,bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:3-clause|new|modified|revised) BSD(?: License)?
80 | BSD-2-Clause | bsd,licensed | licensed under (?:the )?BSD[- ]2[- ]Clause
80 | BSD-3-Clause | bsd,licensed | licensed under (?:the )?BSD[- ]3[- ]Clause
80 | GPL-2.0-or-later | redistribute,gnu,version,later | you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[;,] either version 2 of the License, or \(at your option\) any later version
80 | GPL-3.0-or-later | redistribute,gnu,version,later | you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[;,] either version 3 of the License, or \(at your option\) any later version
80 | GPL-2.0-only | gnu,version | it under the terms of the GNU General Public License,? version 2,? as published by the Free Software Foundation
80 | GPL-3.0-only | gnu,version | it under the terms of the GNU General Public License,? version 3,? as published by the Free Software Foundation
80 | GPL-1.0-only | licensed,gnu,public | licensed under (?:the )?(?:terms of (?:the )?)?GNU General Public License,? (?:v|version )?1(?:\.0)?(?![.\d])
80 | GPL-2.0-only | licensed,gnu,public | licensed under (?:the )?(?:terms of (?:the )?)?GNU General Public License,? (?:v|version )?2(?:\.0)?(?![.\d]*\d)(?! or)
80 | GPL-3.0-only | licensed,gnu,public | licensed under (?:the )?(?:terms of (?:the )?)?GNU General Public License,? (?:v|version )?3(?:\.0)?(?![.\d]*\d)(?! or)
80 | GPL-2.0-or-later | licensed,gnu,public,later | licensed under (?:the )?(?:terms of (?:the )?)?GNU General Public License,? (?:v|version )?2(?:\.0)? or (?:\(at your option\) )?(?:any )?later
80 | GPL-3.0-or-later | licensed,gnu,public,later | licensed under (?:the )?(?:terms of (?:the )?)?GNU General Public License,? (?:v|version )?3(?:\.0)? or (?:\(at your option\) )?(?:any )?later
80 | LGPL-2.1-or-later | gnu,lesser,version,later | under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[;,] either version 2\.1 of the License, or \(at your option\) any later version
80 | LGPL-3.0-or-later | gnu,lesser,version,later | under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[;,] either version 3 of the License, or \(at your option\) any later version
80 | LGPL-2.0-or-later | gnu,library,version,later | under the terms of the GNU Library General Public License as published by the Free Software Foundation[;,] either version 2 of the License, or \(at your option\) any later version
80 | AGPL-3.0-or-later | gnu,affero,version,later | under the terms of the GNU Affero General Public License as published by the Free Software Foundation[;,] either version 3 of the License, or \(at your option\) any later version
80 | AGPL-3.0-only | licensed,affero | licensed under (?:the )?(?:terms of (?:the )?)?GNU Affero General Public License,? (?:v|version )?3(?:\.0)?(?! or)
80 | LGPL-2.1-only | licensed,lesser | licensed under (?:the )?(?:terms of (?:the )?)?GNU Lesser General Public License,? (?:v|version )?2\.1(?! or)
80 | LGPL-3.0-only | licensed,lesser | licensed under (?:the )?(?:terms of (?:the )?)?GNU Lesser General Public License,? (?:v|version )?3(?:\.0)?(?! or)
80 | MPL-2.0 | source,code,form,mozilla | This Source Code Form is subject to the terms of the Mozilla Public License, v\. ?2\.0
80 | MPL-1.1 | contents,file,mozilla | The contents of this file are subject to the Mozilla Public License Version 1\.1
80 | MPL-1.0 | contents,file,mozilla | The contents of this file are subject to the Mozilla Public License Version 1\.0
80 | NPL-1.1 | contents,file,netscape | The contents of this file are subject to the Netscape Public License Version 1\.1
80 | EPL-1.0 | eclipse,made | made available under the terms of the Eclipse Public License v ?1\.0
80 | EPL-2.0 | eclipse,made | made available under the terms of the Eclipse Public License (?:v ?)?2\.0
80 | CDDL-1.0 | common,development,distribution | subject to the terms of the Common Development and Distribution License
80 | CPL-1.0 | common,public,license | made available under the terms of the Common Public License v ?1\.0
80 | BSL-1.0 | boost,distributed | Distributed under the Boost Software License,? Version 1\.0
80 | BSL-1.0 | permission,granted,organization | Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
80 | BUSL-1.1 | business,source,licensed | licensed under (?:the )?Business Source License(?:,? (?:v|version )?1\.1)?
80 | Zlib | software,provided,as-is,implied | This software is provided 'as-is', without any express or implied warranty
80 | Zlib | origin,misrepresented | The origin of this software must not be misrepresented
80 | Unlicense | free,unencumbered,software | This is free and unencumbered software released into the public domain
80 | Unlicense | anyone,compile | Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
80 | WTFPL | fuck,want | (?:You just )?DO WHAT THE FUCK YOU WANT TO
80 | Beerware | beer,return | you can buy me a beer in return
80 | JSON | software,good,evil | The Software shall be used for Good, not Evil
80 | CC0-1.0 | copyright,neighboring | (?:has )?(?:dedicated|waived) all copyright and related or neighboring rights
80 | public-domain | public,domain | (?:has been |is )?(?:placed|released) (?:in|into) the public domain
80 | public-domain | public,domain,dedicated | (?:hereby )?dedicated to the public domain
80 | CC-BY-4.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution(?: \(CC BY\))? 4\.0
80 | CC-BY-3.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution(?: \(CC BY\))? 3\.0
80 | CC-BY-SA-4.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution[- ]Share ?Alike 4\.0
80 | CC-BY-SA-3.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution[- ]Share ?Alike 3\.0
80 | CC-BY-NC-4.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution[- ]Non[- ]?Commercial 4\.0
80 | CC-BY-NC-SA-4.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution[- ]Non[- ]?Commercial[- ]Share ?Alike 4\.0
80 | CC-BY-ND-4.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution[- ]No[- ]?Deriv(?:ative)?s 4\.0
80 | CC-BY-NC-ND-4.0 | licensed,creative,commons,attribution | licensed under (?:a |the )?Creative Commons Attribution[- ]Non[- ]?Commercial[- ]No[- ]?Deriv(?:ative)?s 4\.0
80 | CC-BY-4.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]4\.0
80 | CC-BY-3.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]3\.0
80 | CC-BY-2.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]2\.0
80 | CC-BY-SA-4.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]SA[- ]4\.0
80 | CC-BY-SA-3.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]SA[- ]3\.0
80 | CC-BY-SA-2.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]SA[- ]2\.0
80 | CC-BY-NC-4.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]NC[- ]4\.0
80 | CC-BY-NC-3.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]NC[- ]3\.0
80 | CC-BY-ND-4.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]ND[- ]4\.0
80 | CC-BY-NC-SA-4.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]NC[- ]SA[- ]4\.0
80 | CC-BY-NC-SA-3.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]NC[- ]SA[- ]3\.0
80 | CC-BY-NC-ND-4.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]NC[- ]ND[- ]4\.0
80 | CC-BY-NC-ND-3.0 | licensed,cc,by | licensed under (?:the )?CC[- ]BY[- ]NC[- ]ND[- ]3\.0
80 | Artistic-1.0 | under,artistic,terms | under the terms of the (?:Perl )?Artistic License(?! 2)
80 | Perl-5 | same,terms,perl | under the same terms as Perl(?: 5)?(?: itself)?
80 | Ruby | same,terms,ruby | under the same terms as Ruby(?: itself)?
80 | PSF-2.0 | python,foundation,license | under the (?:terms of the )?Python Software Foundation License
80 | OFL-1.1 | font,licensed,sil | This Font Software is licensed under the SIL Open Font License,? Version 1\.1
80 | EUPL-1.2 | licensed,eupl | licensed under the EUPL,? (?:v|version )?1\.2
80 | EUPL-1.1 | licensed,eupl | licensed under the EUPL,? (?:v|version )?1\.1
80 | SSPL-1.0 | server,side,public | under the (?:terms of the )?Server Side Public License(?:,? (?:v|version )?1)?
80 | Elastic-2.0 | under,elastic | (?:licensed )?under the Elastic License(?:,? (?:v|version )?)?2(?:\.0)?
80 | OpenSSL | product,openssl,toolkit | This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit
80 | PHP-3.01 | product,php,freely | This product includes PHP(?: software)?, freely available
80 | Vim | vim,charityware | Vim is Charityware
80 | GFDL-1.3 | gnu,documentation | under the terms of the GNU Free Documentation License,? Version 1\.3
80 | GFDL-1.2 | gnu,documentation | under the terms of the GNU Free Documentation License,? Version 1\.2
80 | ODbL-1.0 | open,database,license | made available under the Open Database License
80 | proprietary | confidential,proprietary | (?:proprietary and confidential|confidential and proprietary)
80 | proprietary | unauthorized,prohibited | Unauthorized (?:copying|use|reproduction|distribution)[^.]*? is (?:strictly )?prohibited
80 | proprietary | reproduced,permission,written | may (?:not )?be reproduced[^.]*?without (?:the )?(?:prior )?(?:express )?written permission
70 | Apache-2.0 | apache.org/licenses | https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?
70 | MIT | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/(?:mit-license(?:\.php)?|MIT)\b
70 | BSD-3-Clause | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/BSD-3-Clause\b
70 | BSD-2-Clause | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/BSD-2-Clause\b
70 | ISC | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/ISC\b
70 | Zlib | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/zlib(?:-license)?
70 | MS-PL | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/ms-pl\b
70 | AFL-3.0 | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/afl-3\.0
70 | OSL-3.0 | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/osl-3\.0
70 | GPL-2.0-only | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.txt|\.html)?
70 | GPL-3.0-only | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.txt|\.html)?
70 | LGPL-2.1-only | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.txt|\.html)?
70 | LGPL-3.0-only | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.txt|\.html)?
70 | AGPL-3.0-only | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0(?:\.txt|\.html)?
70 | GFDL-1.3 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/fdl-1\.3(?:\.txt|\.html)?
70 | GPL | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/gpl\.(?:txt|html)
70 | GPL | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?![\w.-])
70 | MPL-2.0 | mozilla.org | https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0
70 | MPL-1.1 | mozilla.org | https?://(?:www\.)?mozilla\.org/MPL/MPL-1\.1
70 | EPL-1.0 | eclipse.org/legal | https?://(?:www\.)?eclipse\.org/legal/epl-v10
70 | EPL-2.0 | eclipse.org/legal | https?://(?:www\.)?eclipse\.org/legal/epl-(?:v20|2\.0)
70 | BSL-1.0 | boost.org/license | https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
70 | Unlicense | unlicense.org | https?://(?:www\.)?unlicense\.org
70 | WTFPL | wtfpl.net | https?://(?:www\.|sam\.zoy\.org/)?wtfpl\.net
70 | CC0-1.0 | creativecommons.org/publicdomain | https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0
70 | CC-PDM-1.0 | creativecommons.org/publicdomain | https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0
70 | CC-BY-4.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by/4\.0
70 | CC-BY-3.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by/3\.0
70 | CC-BY-2.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by/2\.0
70 | CC-BY-SA-4.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0
70 | CC-BY-SA-3.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/3\.0
70 | CC-BY-NC-4.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0
70 | CC-BY-NC-3.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by-nc/3\.0
70 | CC-BY-ND-4.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by-nd/4\.0
70 | CC-BY-NC-SA-4.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0
70 | CC-BY-NC-ND-4.0 | creativecommons.org/licenses | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0
70 | OFL-1.1 | scripts.sil.org/ofl | https?://scripts\.sil\.org/OFL
70 | ODbL-1.0 | opendatacommons.org/licenses | https?://(?:www\.)?opendatacommons\.org/licenses/odbl
70 | ODC-By-1.0 | opendatacommons.org/licenses | https?://(?:www\.)?opendatacommons\.org/licenses/by
70 | PDDL-1.0 | opendatacommons.org/licenses | https?://(?:www\.)?opendatacommons\.org/licenses/pddl
60 | Apache-2.0 | apache | \bApache(?: Software)? License,? ?(?:\()?(?:v|version )?2(?:\.0)?\b
60 | Apache-1.1 | apache | \bApache(?: Software)? License,? ?(?:v|version )?1\.1\b
60 | Apache-1.0 | apache | \bApache(?: Software)? License,? ?(?:v|version )?1\.0\b
60 | GPL-1.0-only | gnu,general | \bGNU General Public License,? ?\(?(?:v|version )?1(?:\.0)?(?![.\d]*\d)
60 | GPL-2.0-only | gnu,general | \bGNU General Public License,? ?\(?(?:v|version )?2(?:\.0)?(?![.\d]*\d)
60 | GPL-3.0-only | gnu,general | \bGNU General Public License,? ?\(?(?:v|version )?3(?:\.0)?(?![.\d]*\d)
60 | LGPL-2.0-only | gnu,library | \bGNU Library General Public License,? ?(?:v|version )?2(?:\.0)?(?![.\d]*\d)
60 | LGPL-2.1-only | gnu,lesser | \bGNU Lesser General Public License,? ?(?:v|version )?2\.1
60 | LGPL-3.0-only | gnu,lesser | \bGNU Lesser General Public License,? ?(?:v|version )?3(?:\.0)?
60 | AGPL-3.0-only | affero | \bGNU Affero General Public License,? ?(?:v|version )?3(?:\.0)?
60 | GFDL-1.3 | gnu,documentation | \bGNU Free Documentation License,? ?(?:v|version )?1\.3
60 | GFDL-1.2 | gnu,documentation | \bGNU Free Documentation License,? ?(?:v|version )?1\.2
60 | MPL-1.1 | mozilla | \bMozilla Public License,? ?(?:v\.? ?|version )?1\.1
60 | MPL-2.0 | mozilla | \bMozilla Public License,? ?(?:v\.? ?|version )?2\.0
60 | EPL-1.0 | eclipse | \bEclipse Public License,? ?(?:- )?(?:v\.? ?|version )?1\.0
60 | EPL-2.0 | eclipse | \bEclipse Public License,? ?(?:- )?(?:v\.? ?|version )?2\.0
60 | CDDL-1.0 | development,distribution | \bCommon Development and Distribution License(?: \(CDDL\))?,? ?(?:v|version )?1\.0
60 | CDDL-1.1 | development,distribution | \bCommon Development and Distribution License(?: \(CDDL\))?,? ?(?:v|version )?1\.1
60 | CPL-1.0 | common,public | \bCommon Public License,? ?(?:v|version )?1\.0
60 | BSL-1.0 | boost | \bBoost Software License(?:,? ?(?:- )?(?:v|version )?1\.0)?
60 | BUSL-1.1 | business,source | \bBusiness Source License,? ?(?:v|version )?1\.1
60 | Artistic-2.0 | artistic | \bArtistic License,? ?(?:v|version )?2(?:\.0)?
60 | OFL-1.1 | sil,font | \bSIL Open Font License,? ?(?:v|version )?1\.1
60 | EUPL-1.1 | european,union | \bEuropean Union Public Licen[cs]e,? ?(?:v\.? ?|version )?1\.1
60 | EUPL-1.2 | european,union | \bEuropean Union Public Licen[cs]e,? ?(?:v\.? ?|version )?1\.2
60 | AFL-3.0 | academic,free | \bAcademic Free License,? ?(?:v\.? ?|version )?3\.0
60 | OSL-3.0 | open,software,license | \bOpen Software License,? ?(?:v\.? ?|version )?3\.0
60 | CC-BY-4.0 | creative,commons | \bCreative Commons Attribution 4\.0(?: International)?
60 | CC-BY-3.0 | creative,commons | \bCreative Commons Attribution 3\.0(?: Unported)?
60 | CC-BY-SA-4.0 | creative,commons | \bCreative Commons Attribution[- ]Share ?Alike 4\.0(?: International)?
60 | CC-BY-SA-3.0 | creative,commons | \bCreative Commons Attribution[- ]Share ?Alike 3\.0(?: Unported)?
60 | CC-BY-NC-4.0 | creative,commons | \bCreative Commons Attribution[- ]Non[- ]?Commercial 4\.0(?: International)?
60 | CC-BY-ND-4.0 | creative,commons | \bCreative Commons Attribution[- ]No[- ]?Deriv(?:ative)?s 4\.0(?: International)?
60 | CC-BY-NC-SA-4.0 | creative,commons | \bCreative Commons Attribution[- ]Non[- ]?Commercial[- ]Share ?Alike 4\.0(?: International)?
60 | CC-BY-NC-ND-4.0 | creative,commons | \bCreative Commons Attribution[- ]Non[- ]?Commercial[- ]No[- ]?Deriv(?:ative)?s 4\.0(?: International)?
60 | CC0-1.0 | cc0 | \bCC0(?:[- ]1\.0)?(?: Universal)?\b
60 | SSPL-1.0 | server,side | \bServer Side Public License,? ?(?:v|version )?1
60 | ODbL-1.0 | open,database | \bOpen Database License(?:,? ?\(?ODbL\)?)?,? ?(?:v|version )?1\.0
60 | MulanPSL-2.0 | mulan | \bMulan PSL ?v2
60 | OpenRAIL | open,rail | \b(?:Creative ?ML ?|BigScience ?|Big ?Code ?)?Open ?RAIL(?:-[MDS+]+)?\b
60 | LLaMA-community | llama,community | \bLlama (?:[23](?:\.\d)? )?Community License(?: Agreement)?
50 | GPL-2.0-only | gpl | \bGPL(?: ?|-)?(?:v|version )?2(?:\.0)?(?:-only)?(?![-.+\d]*[+\d])
50 | GPL-2.0-or-later | gpl | \bGPL(?: ?|-)?(?:v|version )?2(?:\.0)?(?:\+|-or-later)
50 | GPL-3.0-only | gpl | \bGPL(?: ?|-)?(?:v|version )?3(?:\.0)?(?:-only)?(?![-.+\d]*[+\d])
50 | GPL-3.0-or-later | gpl | \bGPL(?: ?|-)?(?:v|version )?3(?:\.0)?(?:\+|-or-later)
50 | LGPL-2.1-only | lgpl | \bLGPL(?: ?|-)?(?:v|version )?2\.1(?:-only)?(?!\+)
50 | LGPL-3.0-only | lgpl | \bLGPL(?: ?|-)?(?:v|version )?3(?:\.0)?(?:-only)?(?!\+)
50 | AGPL-3.0-only | agpl | \bAGPL(?: ?|-)?(?:v|version )?3(?:\.0)?(?:-only)?(?!\+)
50 | MPL-2.0 | mpl | \bMPL(?: ?|-)?(?:v|version )?2(?:\.0)?\b
50 | MPL-1.1 | mpl | \bMPL(?: ?|-)?(?:v|version )?1\.1\b
50 | BSD-2-Clause | bsd | \b(?:BSD[- ]2[- ]Clause|(?:2-clause|two-clause|simplified) BSD)(?: License)?
50 | BSD-3-Clause | bsd | \b(?:BSD[- ]3[- ]Clause|(?:3-clause|three-clause|new|modified|revised) BSD)(?: License)?
50 | BSD-4-Clause | bsd | \b(?:BSD[- ]4[- ]Clause|(?:4-clause|four-clause|original) BSD)(?: License)?
50 | 0BSD | 0bsd | \b0BSD\b
50 | MIT | mit,license | \b(?:The )?MIT License\b
50 | MIT | expat | \bExpat License\b
50 | ISC | isc,license | \bISC License\b
50 | Zlib | zlib,license | \b(?:the )?zlib(?:/libpng)? License\b
50 | NCSA | illinois,ncsa | \bUniversity of Illinois/NCSA Open Source License
50 | MS-PL | microsoft,public | \bMicrosoft Public License\b
50 | MS-RL | microsoft,reciprocal | \bMicrosoft Reciprocal License\b
50 | PostgreSQL | postgresql,license | \bPostgreSQL License\b
50 | PSF-2.0 | python,foundation | \bPython Software Foundation License\b
50 | CC-BY-4.0 | cc,by,4.0 | \bCC[- ]BY[- ]4\.0\b
50 | CC-BY-3.0 | cc,by,3.0 | \bCC[- ]BY[- ]3\.0\b
50 | CC-BY-SA-4.0 | cc,sa,4.0 | \bCC[- ]BY[- ]SA[- ]4\.0\b
50 | CC-BY-SA-3.0 | cc,sa,3.0 | \bCC[- ]BY[- ]SA[- ]3\.0\b
50 | CC-BY-NC-4.0 | cc,nc,4.0 | \bCC[- ]BY[- ]NC[- ]4\.0\b
50 | CC-BY-NC-3.0 | cc,nc,3.0 | \bCC[- ]BY[- ]NC[- ]3\.0\b
50 | CC-BY-NC-SA-4.0 | cc,nc,sa | \bCC[- ]BY[- ]NC[- ]SA[- ]4\.0\b
50 | CC-BY-NC-ND-4.0 | cc,nc,nd | \bCC[- ]BY[- ]NC[- ]ND[- ]4\.0\b
50 | CC-BY-ND-4.0 | cc,nd,4.0 | \bCC[- ]BY[- ]ND[- ]4\.0\b
50 | WTFPL | wtfpl | \bWTFPL\b
50 | Unlicense | unlicense | \b(?:The )?Unlicense\b
50 | Beerware | beer-ware | \bBEER-WARE LICENSE\b
40 | Apache | apache,license | \bApache(?: Software)? License\b
40 | GPL | gnu,general | \bGNU General Public License\b
40 | LGPL | gnu,general,public | \bGNU (?:Lesser|Library) General Public License\b
40 | AGPL | affero | \b(?:GNU )?Affero General Public License\b
40 | GFDL | gnu,documentation | \bGNU Free Documentation License\b
40 | MPL | mozilla | \bMozilla Public License\b
40 | EPL | eclipse | \bEclipse Public License\b
40 | CDDL | cddl | \bCDDL\b
40 | BSD | bsd | \bBSD(?:-style)? Licen[cs]e\b
40 | Artistic | artistic | \bArtistic License\b
40 | CC-BY | creative,commons | \bCreative Commons Attribution\b(?![- ](?:Share|Non|No))
40 | CC-BY-SA | creative,commons | \bCreative Commons Attribution[- ]Share ?Alike\b
40 | CC-BY-NC | creative,commons | \bCreative Commons Attribution[- ]Non[- ]?Commercial\b
40 | CC | creative,commons | \bCreative Commons(?: Licen[cs]e)?\b
40 | CC-BY-SA | cc,sa | \bCC[- ]BY[- ]SA\b
40 | CC-BY-NC | cc,nc | \bCC[- ]BY[- ]NC\b
40 | GPL | gpl | \bGPL\b
40 | LGPL | lgpl | \bLGPL\b
40 | AGPL | agpl | \bAGPL\b
40 | EUPL | eupl | \bEUPL\b
40 | public-domain | public,domain | \bpublic domain\b
20 | all-rights-reserved | rights,reserved | \bAll rights reserved\b\.?
20 | copyright-notice | copyright | \bCopyright (?:\(c\) )?(?:\d{4}(?:[-,] ?\d{4})*,? )(?:by )?[^\n]{1,80}
20 | copyright-notice | © | ©\s?\d{4}[^\n]{0,80}
20 | unnamed-license | licensed,under | \blicensed under\b
20 | unnamed-license | see,license | \bsee (?:the )?(?:accompanying )?LICENSE(?:\.txt|\.md)?(?: file)?\b
20 | unnamed-license | terms,apply | \b(?:our |the )?terms of (?:use|service) apply\b
20 | no-derivatives | without,permission | \bmay not be (?:copied|redistributed|modified)[^.\n]* without permission\b
20 | non-commercial | non-commercial | \bfor non-commercial use only\b
20 | evaluation | evaluation,purposes | \bfor evaluation purposes only\b
20 | trademark | registered,trademark | \bregistered trademarks?\b
20 | copyright-notice | copyright | \bCopyright (?:\(c\) )?(?:\d{4}(?:[-,] ?\d{4})*,? )(?:by )?[^\n]{80}(?:(?!\bCopyright |©|\bAll rights reserved|\blicensed under|\bsee (?:the )?(?:accompanying )?LICENSE|\b(?:our |the )?terms of (?:use|service) apply|\bmay not be|\bfor non-commercial|\bfor evaluation|\bregistered trademark)[^\n])+
20 | copyright-notice | © | ©\s?\d{4}[^\n]{80}(?:(?!\bCopyright |©|\bAll rights reserved|\blicensed under|\bsee (?:the )?(?:accompanying )?LICENSE|\b(?:our |the )?terms of (?:use|service) apply|\bmay not be|\bfor non-commercial|\bfor evaluation|\bregistered trademark)[^\n])+
"""
