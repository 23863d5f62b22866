"""Wordings that name a license: notices, SPDX tags and the telling paragraphs of license texts.

{...} stands for any words, up to licenses.WILD of them.
"""

from __future__ import annotations

NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "This software is available under the Apache 2.0 license."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v2."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Licensed under the three clause BSD license."),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the two clause BSD license."),
    "MPL-2.0": ("This file is subject to the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "ISC": ("Released under the ISC License.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all rights to this work under CC0 1.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2.",),
    "Proprietary": ("All rights reserved.", "Copyright {year and holder}. All rights reserved."),
}

_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU"
_PUBLISHED = "as published by the Free Software Foundation, either version"
_LATER = "of the License, or (at your option) any later version."

TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Apache License Version 2.0, January 2004",
    ),
    "GPL-3.0": (f"This program {_FREE} General Public License {_PUBLISHED} 3 {_LATER}", "GNU General Public License Version 3", "GNU General Public License Version 3, 29 June 2007"),
    "GPL-2.0": (f"This program {_FREE} General Public License {_PUBLISHED} 2 {_LATER}", "GNU General Public License Version 2", "GNU General Public License Version 2, June 1991"),
    "LGPL-3.0": (f"This library {_FREE} Lesser General Public License {_PUBLISHED} 3 {_LATER}", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "LGPL-2.1": (f"This library {_FREE} Lesser General Public License {_PUBLISHED} 2.1 {_LATER}", "GNU Lesser General Public License Version 2.1, February 1999"),
    "AGPL-3.0": (f"This program {_FREE} Affero General Public License {_PUBLISHED} 3 {_LATER}", "GNU Affero General Public License Version 3, 19 November 2007"),
    "BSD-2-Clause OR BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD-3-Clause": ("Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ),
    "Unlicense": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "CC0-1.0": ("To the extent possible under law, {author} has waived all copyright and related or neighboring rights to {work}.",),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit",),
}

#: Identifiers for tags, and the license that each names.
TAGS = {name: name for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "EPL-2.0", "EUPL-1.2", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")} | {
    f"{name}{end}": name for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("", "-only", "-or-later")
}

TEMPLATES: dict[str, tuple[str, ...]] = {
    name: (*NOTICES.get(name, ()), *(f"SPDX-License-Identifier: {tag}" for tag, own in TAGS.items() if own == name), *TEXTS.get(name, ())) for name in dict.fromkeys([*NOTICES, *TEXTS, *TAGS.values()])
}
